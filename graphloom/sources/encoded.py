"""Encoded graphs, dictionaries and query files, and what is written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import escaped
from ..operators.store import Dictionary
from ..plans.syntax import split_queries

_EDGE = r"^\s*<?(\d+)>?\s+<?(\d+)>?\s+<?(\d+)>?(?:\s*\.)?\s*$"


def read_encoded(spark: SparkSession, path: str, layout: str = "spo") -> DataFrame:
    """(s, p, o) of ids, from lines `<s> <p> <o> .`; header lines with counts don't match. layout: the columns' order, "sop" for dumps."""
    at = {name: i for i, name in enumerate(layout)}
    inside = lambda i: F.substring_index(F.substring_index("value", ">", i + 1), "<", -1).try_cast("long")
    lines = spark.read.text(path).select("value", *[inside(i).alias(f"x{i}") for i in range(3)])
    # a line that its three numbers make again needs no regular expression
    again = F.concat(F.lit("<"), F.col("x0").cast("string"), F.lit("> <"), F.col("x1").cast("string"), F.lit("> <"), F.col("x2").cast("string"), F.lit("> .")) == F.col("value")
    plain = again & (F.col("x0") >= 0) & (F.col("x1") >= 0) & (F.col("x2") >= 0)
    numbers = F.regexp_extract_all("value", F.lit(r"(\d+)"))  # three of them, in such a line
    row = lambda x: F.array(F.struct(*[x(at[c]).alias(c) for c in "spo"]))
    # unfolded, so that a condition on a number doesn't read the line another time
    return lines.select(F.inline(F.when(plain, row(lambda i: F.col(f"x{i}"))).when(F.col("value").rlike(_EDGE), row(lambda i: numbers[i].cast("long")))))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, term) from lines `id term`; the term runs to the end of the line."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d+ ")).withColumn("id", F.substring_index("value", " ", 1))
    return lines.select(F.col("id").cast("long").alias("id"), F.substring("value", F.length("id") + 2, F.length("value")).alias("term"))


def read_queries(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(file, number in it, text) of every query in the files at path, by file name. Queries are few; they go to the driver."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return [(r.name, i, q) for r in sorted(rows, key=lambda r: r.name) for i, q in enumerate(split_queries(r.value))]


def write_encoded(encoded: DataFrame, path: str) -> tuple[int, int]:
    """Lines `<s> <p> <o> .` in path/edges, and path/counts with the numbers of edges and nodes, which are returned."""
    line = F.concat_ws(" ", *[F.concat(F.lit("<"), F.col(c).cast("string"), F.lit(">")) for c in "spo"], F.lit("."))
    encoded.select(line.alias("value")).write.text(f"{path}/edges")
    # counted in what was written, so that the graph is encoded once; nodes as bits, 64 ids a row
    ends = read_encoded(encoded.sparkSession, f"{path}/edges").select(F.explode(F.array("s", "o")).alias("x"))
    words = ends.groupBy(F.shiftright("x", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int)))").alias("bits"), F.count("*").alias("n"))
    found = words.agg(F.sum("n").alias("n"), F.sum(F.bit_count("bits")).alias("nodes")).first()
    edges, nodes = (found.n or 0) // 2, found.nodes or 0
    encoded.sparkSession.createDataFrame([(f"{edges}\n{nodes}",)], "value string").coalesce(1).write.text(f"{path}/counts")
    return edges, nodes


def write_dictionary(dictionary: Dictionary, path: str) -> None:
    for name, df in (("nodes", dictionary.nodes), ("predicates", dictionary.predicates)):
        df.select(F.concat_ws(" ", F.col("id").cast("string"), F.regexp_replace("term", r"[\n\r]", " ")).alias("value")).write.text(f"{path}/{name}")


def matrix_market(encoded: DataFrame) -> DataFrame:
    """(row, col, val) from 1 on."""
    return encoded.select((F.col("s") + 1).alias("row"), (F.col("o") + 1).alias("col"), F.col("p").alias("val"))


def write_matrix_market(encoded: DataFrame, path: str, n_nodes: int | None = None) -> None:
    """Coordinate format: the header in path/header, the cells in path/cells."""
    cells = matrix_market(encoded)
    found = encoded.agg((F.max(F.greatest("s", "o")) + 1).alias("nodes"), F.count("*").alias("n")).first()
    n_nodes = (found.nodes or 0) if n_nodes is None else n_nodes
    header = f"%%MatrixMarket matrix coordinate real general\n{n_nodes} {n_nodes} {found.n}"
    encoded.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/header")
    cells.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("row", "col", "val")]).alias("value")).write.text(f"{path}/cells")


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat(escaped(F.col("s")), F.lit(" "), escaped(F.col("p")), F.lit(" "), escaped(F.col("o")), F.lit(" .")).alias("value")).write.text(path)


def write_results(df: DataFrame, path: str, ids: bool = False) -> None:
    """A line for each solution, its terms (or `<id>`s) in projection order."""
    cell = lambda c: F.coalesce(F.concat(F.lit("<"), F.col(f"`{c}`").cast("string"), F.lit(">")) if ids else F.col(f"`{c}`").cast("string"), F.lit(""))
    df.select(F.concat_ws(" ", *[cell(c) for c in df.columns]).alias("value")).write.text(path)


def result_text(df: DataFrame, rows: int = 1000) -> str:
    """Variable names and the first rows, in projection order: for a console."""
    lines = [" ".join(f"?{c}" for c in df.columns)]
    lines += [" ".join("" if v is None else str(v) for v in r) for r in df.limit(rows).collect()]
    return "\n".join(lines)


def write_cells(matrix: DataFrame, path: str) -> None:
    """A line `(i, j): x` for each cell (u, v, x) that is set."""
    matrix.select(F.format_string("(%s, %s): %s", F.col("u").cast("string"), F.col("v").cast("string"), F.col("x").cast("string")).alias("value")).write.text(path)


def write_vector(df: DataFrame, column: str, path: str) -> None:
    """A line for each member."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """`key value` lines."""
    df.select(F.concat_ws(" ", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.text(path)


def write_statistics(frequencies: DataFrame, path: str) -> None:
    """`n term` by ascending count."""
    frequencies.orderBy("n", "term").select(F.concat_ws(" ", F.col("n").cast("string"), "term").alias("value")).write.text(path)
