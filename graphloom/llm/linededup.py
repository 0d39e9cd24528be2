"""Line dedup by a suffix array over line ids (operator 6).

A text is a sequence of lines (trimmed; those without words are left out) and
all texts together, in order of (doc_id, text_key), are one sequence in which no
suffix runs on past its document. Distributed prefix doubling ranks the suffixes
by their first 1, 2, 4, ... lines: the rank by 2n lines follows from the pair of
ranks by n lines of a suffix and of the one n lines on. A suffix whose rank is
its own alone has no repeated beginning of that length and is discarded. Runs
that matter have MIN_WORDS words, so the doubling ends once it has passed the
longest window (below).

Suffixes that share their first L lines are one interval of the suffix array
with common prefix L (a pair of ranks by the greatest power of two in L, at the
run's head and at its end, names it). In each interval the earliest suffix keeps
its lines; a later copy that doesn't overlap it loses them. That holds for runs
of any length, but two kinds of window are enough to look at: those that can't
lose their last line, and those that can't lose their first one, without falling
under MIN_WORDS. A window of the first kind starts at each line of a repeated
run up to the last that has MIN_WORDS words from it on; one of the second kind
starts there and ends where the run ends. Together they cover the maximal run;
two lines make a window where the first has words enough, so that blank lines
between them are covered too. A text has at most three windows a line, none of
more than MIN_WORDS lines.

Ranks are sums over a range-partitioned sort: no single task sees all of them,
and hot lines count through partial aggregation; joins deal hot ranks and runs
out by a salt. A line is named by two independent 64-bit hashes.

Nulls: a null text has no lines and stays null; a null doc_id comes first in the
order. Repeated rows (same doc_id and text) are one document and keep or lose
the same lines. Texts of any length are cut into lines whole; an empty one has
none. Ties cannot occur: the order of documents and lines is total.
Blank lines between deleted lines go too. An empty table gives an empty one.
Columns of any other name stay; only the one asked for as `removed` must be free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

MIN_WORDS = 50


def _lines(min_words: int):
    """Per line with words: its place among them (i), its number in the text, its two hashes, and the numbers of lines (need to most) of the windows that start at it, or nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, bounds in tk.text_chunks(batch.column("text")):
                starts, ends, first = tk.word_spans(data, bounds, tk.SOLID)
                if not len(starts):
                    continue
                newlines = np.zeros(len(data) + 1, np.int64)
                np.cumsum(data == 10, out=newlines[1:])
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                number = newlines[starts] - newlines[bounds[row]]
                head = np.ones(len(starts), bool)
                head[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
                at = np.flatnonzero(head)
                after = np.append(at[1:], len(starts))
                of = row[at]
                h, g = (tk.signed(tk.span_hashes(data, starts[at], ends[after - 1], seed)) for seed in (0, 1))
                lines = np.searchsorted(of, np.arange(len(first)))
                words = np.append(at, len(starts))  # words before each line
                stop = np.searchsorted(words, words[:-1] + min_words)
                last = lines[of + 1]
                fits = stop <= last
                # longer windows, until the line after this one has min_words of its own
                line = np.arange(len(at))
                most = np.maximum(stop, np.minimum(np.append(stop[1:], 0) - 1, last))
                most = np.where(line + 1 < last, np.maximum(most, line + 2), stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(lo + of)), batch.column("text_key").take(pa.array(lo + of)), pa.array((line - lines[of]).astype(np.int32)),
                        pa.array(number[at].astype(np.int32)), pa.array(h), pa.array(g), pa.array((stop - line).astype(np.int32), mask=~fits),
                        pa.array((most - line).astype(np.int32), mask=~fits),
                    ],
                    names=["doc_id", "text_key", "i", "number", "h", "g", "need", "most"],
                )

    return run


def _ranked(steps: tk.Steps, groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups (keys, n) with rank: how many suffixes lie in lesser groups. The sort is by range; only its partitions' sums meet."""
    ordered = steps.store(groups.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sums = {r.part: r.n for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    if not before:
        return ordered.select(*keys, "n", F.lit(0).cast("long").alias("rank"))
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    running = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return steps.store(ordered.select(*keys, "n", (offsets[F.col("part")] + F.coalesce(F.sum("n").over(running), F.lit(0))).alias("rank")))


def suffix_ranks(steps: tk.Steps, lines: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text_key, i, number, need, most, r0, r1, ..., K): ranks by the first 2**k lines, null where such a beginning has no copy."""
    position = ["doc_id", "text_key"]
    first = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
    ranks = _ranked(steps, first, ["h", "g"])
    table = steps.store(tk.skew_join(lines, ranks.select("h", "g", F.col("rank").alias("r0")), ranks, ["h", "g"]).drop("h", "g"))
    k = 0
    while True:
        # windows of 2n lines or more whose first n lines have a copy
        open_ = table.where((F.col("most") >= 2 ** (k + 1)) & F.col(f"r{k}").isNotNull())
        if open_.isEmpty():
            return table, k
        ahead = Window.partitionBy(*position).orderBy("i").rangeBetween(2**k, 2**k)
        paired = steps.store(table.withColumn("on", F.first(f"r{k}").over(ahead)))
        steps.drop(table)
        keys = [f"r{k}", "on"]
        ranks = _ranked(steps, paired.where(f"r{k} IS NOT NULL AND on IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), keys)
        table = steps.store(tk.skew_join(paired, ranks.select(*keys, F.col("rank").alias(f"r{k + 1}")), ranks, keys, "left").drop("on"))
        steps.drop(paired)
        k += 1


def later_copies(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, spans: [from, to] line numbers (ends included) of the document's later copies, ascending and apart. A stored table."""
    with tk.Steps(spark) as steps:
        columns = "doc_id bigint, text_key bigint, i int, number int, h bigint, g bigint, need int, most int"
        lines = steps.store(tk.keyed_texts(docs).mapInArrow(tk.released(_lines(min_words)), columns).dropDuplicates(["doc_id", "text_key", "i"]))
        table, top = suffix_ranks(steps, lines)
        steps.drop(lines)
        of = Window.partitionBy("doc_id", "text_key").orderBy("i")
        windows = F.array().cast("array<struct<n:int,head:bigint,tail:bigint,end:int>>")
        for k in range(top + 1):
            # windows have at most 2**(k+1) - 1 lines here: their last 2**k lines start n - 2**k lines on
            later = F.collect_list(F.struct("i", f"r{k}", "number")).over(of.rangeBetween(0, 2 ** (k + 1) - 2))
            line = lambda n, back: F.get(F.filter(later, lambda x: x["i"] == F.col("i") + n - back), F.lit(0))  # noqa: B023, E731
            lengths = F.sequence(F.greatest("need", F.lit(2**k)), F.least("most", F.lit(2 ** (k + 1) - 1)))
            here = F.transform(lengths, lambda n: F.struct(n.alias("n"), F.col(f"r{k}").alias("head"), line(n, 2**k)[f"r{k}"].alias("tail"), line(n, 1)["number"].alias("end")))  # noqa: B023
            within = F.col(f"r{k}").isNotNull() & (F.col("most") >= 2**k) & (F.col("need") < 2 ** (k + 1))
            windows = F.concat(windows, F.when(within, here).otherwise(F.array()))
        runs = table.select("doc_id", "text_key", "i", "number", windows.alias("windows")).select("doc_id", "text_key", "i", "number", F.inline("windows")).withColumnRenamed("n", "need")
        runs = steps.store(runs.where("tail IS NOT NULL AND end IS NOT NULL"))
        steps.drop(table)
        # intervals of the suffix array: suffixes with a common prefix of `need` lines
        names = ["need", "head", "tail"]
        intervals = steps.store(runs.groupBy(*names).agg(F.min(F.struct("doc_id", "text_key", "i")).alias("f"), F.count("*").alias("n")).where("n > 1"))
        both = tk.skew_join(runs, intervals.select(*names, "f"), intervals, names)
        same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_key") == F.col("f.text_key"))
        copies = both.where(~same | (F.col("i") >= F.col("f.i") + F.col("need"))).select("doc_id", "text_key", F.col("number").alias("from"), F.col("end").alias("to"))
        # spans that meet become one
        by = Window.partitionBy("doc_id", "text_key").orderBy("from", "to")
        before = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
        numbered = copies.withColumn("apart", F.when(F.col("from") <= before, 0).otherwise(1)).withColumn("span", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        merged = numbered.groupBy("doc_id", "text_key", "span").agg(F.min("from").alias("from"), F.max("to").alias("to"))
        return steps.keep(merged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans")))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "removed_lines") -> DataFrame:
    """docs with text less its later copies, and a column (removed) with the number of lines that went. All other columns stay.

    Only texts that may lose lines are shuffled.
    """
    if removed.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {removed} is taken")
    by_id, by_key, spans, kept = tk.fresh(docs, "of_id", "of_key", "later_spans", "kept_lines")
    gone = later_copies(spark, docs, min_words)
    some, rest = tk.parts(spark, docs, gone)
    gone = gone.select(F.col("doc_id").alias(by_id), F.col("text_key").alias(by_key), F.col("spans").alias(spans))
    joined = some.join(tk.merged(gone), tk.named(docs, by_id, by_key), "left")
    lines, has = F.split("text", "\n", -1), F.col(spans).isNotNull()
    numbers = F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"])))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers), lambda n: F.get(lines, n))
    joined = joined.withColumn(kept, F.when(has, left))
    new = F.when(has, F.array_join(kept, "\n")).otherwise(F.col("text"))
    n = F.when(has, F.size(lines) - F.size(kept)).otherwise(0).cast("long")
    edited = joined.select(*[(new.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns], n.alias(removed))
    return edited.unionAll(rest.withColumn(removed, F.lit(0).cast("long")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark, tk.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("removed_lines").alias("n_removed"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def drop_copies(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts deduplicated; a document of which nothing is left goes. All columns stay."""
    (removed,) = tk.fresh(docs, "removed_lines")
    done = dedup_lines(spark, docs, min_words, removed)
    empty = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return done.where(~F.coalesce(empty, F.lit(False))).drop(removed)


#: Pairs of equal lines, joined to runs along their diagonals. A run of a copy within the same text may be as long as the two are apart.
OP6_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
a AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS number FROM d WHERE text IS NOT NULL),
b AS (SELECT doc_id, number, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY number) AS upto FROM b WHERE w > 0),
p AS (SELECT x.doc_id AS da, y.doc_id AS db, y.i AS i, y.i - x.i AS apart FROM c x JOIN c y ON x.line = y.line AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.i < y.i)),
q AS (SELECT *, i - row_number() OVER (PARTITION BY da, db, apart ORDER BY i) AS island FROM p),
r AS (SELECT da, db, apart, min(i) AS first, max(i) AS last FROM q GROUP BY da, db, apart, island),
s AS (SELECT DISTINCT db, first, last FROM r WHERE da <> db UNION SELECT db, t AS first, least(t + apart - 1, last) AS last FROM (SELECT *, unnest(range(first, last + 1)) AS t FROM r WHERE da = db)),
h AS (SELECT DISTINCT s.db AS doc_id, x.number, y.number AS last FROM s JOIN c x ON x.doc_id = s.db AND x.i = s.first JOIN c y ON y.doc_id = s.db AND y.i = s.last WHERE y.upto - x.upto + x.w >= {MIN_WORDS}),
gone AS (SELECT DISTINCT a.doc_id, a.number FROM a JOIN h ON a.doc_id = h.doc_id AND a.number BETWEEN h.number AND h.last),
kept AS (SELECT a.doc_id, string_agg(a.raw, chr(10) ORDER BY a.number) AS t FROM a ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.number = gone.number GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END)::BIGINT AS n_chars_left,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END) AS text_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
