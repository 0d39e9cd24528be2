"""The matrix vocabulary of graph queries, on relations.

A matrix is a DataFrame (u, v) of the cells that are set, a vector a DataFrame
(v) of distinct members, a labelled matrix (u, v, x). Products are joins, masks
are semi-joins and reductions are distincts, so Catalyst plans them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product over (or, and): pairs that a path a then b connects."""
    return a.select("u", F.col("v").alias("__k")).join(b.select(F.col("u").alias("__k"), "v"), "__k").select("u", "v").distinct()


def compose_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product over (or, equals) of labelled matrices: pairs with some k where both labels are the same."""
    return a.select("u", F.col("v").alias("__k"), "x").join(b.select(F.col("u").alias("__k"), "v", "x"), ["__k", "x"]).select("u", "v").distinct()


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("v").alias("u"), F.col("u").alias("v"))


def reduce_rows(m: DataFrame) -> DataFrame:
    """The vector of rows that aren't empty (the row diagonal)."""
    return m.select(F.col("u").alias("v")).distinct()


def reduce_cols(m: DataFrame) -> DataFrame:
    """The vector of columns that aren't empty (the column diagonal)."""
    return m.select("v").distinct()


def row(m: DataFrame, u: Column | str) -> DataFrame:
    return m.where(F.col("u") == u).select("v")


def col(m: DataFrame, v: Column | str) -> DataFrame:
    return m.where(F.col("v") == v).select(F.col("u").alias("v"))


def point(m: DataFrame, u: str, v: str) -> DataFrame:
    """The cell as a relation of at most one row."""
    return m.where((F.col("u") == u) & (F.col("v") == v)).limit(1)


def cell(df_like: DataFrame, u: str, v: str) -> DataFrame:
    """A matrix with one cell set."""
    return df_like.sparkSession.createDataFrame([(u, v)], "u string, v string")


def has_row(m: DataFrame, u: str) -> bool:
    return not row(m, u).isEmpty()


def has_col(m: DataFrame, v: str) -> bool:
    return not col(m, v).isEmpty()


def profile(m: DataFrame) -> DataFrame:
    """nnz, rows, cols: cells that are set, rows and columns that aren't empty."""
    return m.agg(F.count("*").alias("nnz"), F.countDistinct("u").alias("rows"), F.countDistinct("v").alias("cols"))


def mask_rows(m: DataFrame, vector: DataFrame) -> DataFrame:
    """Cells whose row is in the vector."""
    return m.join(vector.select(F.col("v").alias("u")), "u", "left_semi").select("u", "v")


def mask_cols(m: DataFrame, vector: DataFrame) -> DataFrame:
    """Cells whose column is in the vector."""
    return m.join(vector.select("v"), "v", "left_semi").select("u", "v")


def mxv(m: DataFrame, vector: DataFrame) -> DataFrame:
    """Rows with a cell in the vector's columns."""
    return reduce_rows(mask_cols(m, vector))


def mxv_trans(m: DataFrame, vector: DataFrame) -> DataFrame:
    """Columns with a cell in the vector's rows."""
    return reduce_cols(mask_rows(m, vector))


def vandv(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of both vectors."""
    return a.join(b, "v", "left_semi")


def binding_matrix(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells with row and column in the given vectors."""
    return mask_cols(mask_rows(m, rows), cols)


def r_join(r: DataFrame, m: DataFrame, on: str, new: str) -> DataFrame:
    """Result rows extended along a matrix: column on meets u, column new takes v."""
    return r.join(m.select(F.col("u").alias(on), F.col("v").alias(new)), on)


def r_filter(r: DataFrame, m: DataFrame, a: str, b: str) -> DataFrame:
    """Result rows whose pair (a, b) is a cell: closes a cycle. Multiplicity stays."""
    return r.join(m.select(F.col("u").alias(a), F.col("v").alias(b)), [a, b], "left_semi")


def prune_forward(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Cells of child whose row is a column of parent: one step down the query's tree."""
    return mask_rows(child, reduce_cols(parent))


def prune_backward(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Cells of parent whose column is a row of child: one step back up."""
    return mask_cols(parent, reduce_rows(child))


def close_cycle(closing: DataFrame, leaving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both matrices at a node that a cycle meets twice, each pruned by the other: closing by column, leaving by row."""
    closed = mask_cols(closing, reduce_rows(leaving))
    return closed, mask_rows(leaving, reduce_cols(closed))


def gini(values: DataFrame, column: str) -> DataFrame:
    """The Gini coefficient of a column of counts: sum over pairs of distinct values, by their frequencies.

    Distinct values are sorted and numbered by ranges, so no task holds them all.
    """
    from .ranking import numbered

    freq = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("f"))
    ranked = numbered(freq, ["x"], "__at")
    total = freq.agg(F.sum("f").alias("n"), F.sum(F.col("x") * F.col("f")).alias("t")).first()
    if not total.n or not total.t:
        return values.sparkSession.createDataFrame([(0.0,)], "gini double")
    # sum of i * x over sorted rows: a value with f rows after c others adds x * f * (c + (f + 1) / 2)
    below = running_total(ranked, "__at", "f", "before")
    s = below.agg(F.sum(F.col("x") * F.col("f") * (F.col("before") + (F.col("f") + 1) / 2)).alias("s"))
    n, t = float(total.n), float(total.t)
    return s.select((2 * F.col("s") / F.lit(n * t) - F.lit((n + 1) / n)).alias("gini"))


def running_total(df: DataFrame, order: str, amount: str, name: str, block: int = 100_000) -> DataFrame:
    """df with the sum of amount over rows of lower order (a dense number): within blocks by a window, and blocks' sums before."""
    from pyspark.sql import Window

    df = df.withColumn("__block", F.floor(F.col(order) / block))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("__block").agg(F.sum(amount).alias("__sum"))
    # a row for each block: 10**11 distinct values make a million of them, which one task adds up
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    return df.join(before, "__block").withColumn(name, F.col("__before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("__block", "__before")
