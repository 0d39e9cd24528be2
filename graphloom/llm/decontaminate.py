"""Benchmark decontamination by winnowing (operator 1).

Fingerprints are minimum hashes of GRAM consecutive words in every window of
WINDOW - GRAM + 1 of them, so any WINDOW words that a document shares with an
item hold a fingerprint that both sides keep. The kept fingerprints are joined
and each match is extended to both sides; runs of WINDOW words or more are hits.

Grams that hold more than one in HOT_GRAMS of the items' places count as greater
than all others on both sides, so a window is named by such a gram only if it
has no other; the guarantee holds for any order.

A fixed-size bit table of the items' fingerprints (1 MB, whatever the number of
items) is applied before the join, so only a document's likely matches leave
the scan. An item of fewer than WINDOW words is one window itself; documents
are then searched at every position for its length (winnowing with window 1).

Nulls: a null text has no words; items with a null id mark words but are not
listed. Repeated rows (same doc_id and text) give one row. Same doc_id with
other text: a row each. Texts of any length are searched whole, a few megabytes
or one text at a time; an empty one has no words. Ties: of equal grams in a window the last one is kept,
on both sides. An empty benchmark leaves every document clean; an empty table
gives an empty one. Other columns, whatever their names, are not looked at; the
filtering stage passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW = 10
GRAM = 5
#: Bits of the table that thins out fingerprints before the join: 1 MB.
FILTER_BITS = 1 << 23
#: A gram of more than one in so many places of the items is common: there are fewer than this.
HOT_GRAMS = 1_000

_PRINT = "array<struct<k:int,fp:bigint,at:int,left:array<bigint>,mid:array<bigint>,right:array<bigint>>>"
_PRINT_TYPE = pa.struct([("k", pa.int32()), ("fp", pa.int64()), ("at", pa.int32()), ("left", pa.list_(pa.int64())), ("mid", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])


def winnow(grams: np.ndarray, first: np.ndarray, gram: int, window: int, common: np.ndarray | None = None) -> np.ndarray:
    """Indices of words whose gram is the (rightmost) minimum of a window that lies in one row; common (ascending) grams come last in the order."""
    wide = window - gram + 1
    at = tk.gram_starts(first, window)
    if len(at) == 0:
        return at
    order = grams >> np.uint64(1)
    if common is not None and len(common):
        order = order | ((common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams).astype(np.uint64) << np.uint64(63))
    views = np.lib.stride_tricks.sliding_window_view(order, wide)[at, ::-1]
    picked = at + (wide - 1 - views.argmin(axis=1))
    keep = np.zeros(len(grams), bool)
    keep[picked] = True
    return np.flatnonzero(keep)


def _around(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> pa.ListArray:
    """words[lo:hi] for each pair, backwards if step is -1."""
    counts = hi - lo
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    index = np.repeat(lo, counts) + at if step > 0 else np.repeat(hi - 1, counts) - at
    return tk.list_array(pa.array(tk.signed(words[index])), counts)


def _prints(words: np.ndarray, first: np.ndarray, lengths: list[int], bits: np.ndarray | None, whole: bool, window: int, gram: int, common: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Fingerprints of each row and how many. whole: a short row is one window; lengths: short windows to look for."""
    parts: list[tuple[np.ndarray, np.ndarray, int]] = []
    sizes = np.diff(first)
    grams = tk.gram_hashes(words, gram)
    at = winnow(grams, first, gram, window, common)
    parts.append((at, grams[at], gram))
    for m in lengths:
        fp = tk.gram_hashes(words, m)
        at = first[:-1][sizes == m] if whole else tk.gram_starts(first, m)
        parts.append((at, fp[at] ^ np.uint64(0x5555 + m), -m))
    at = np.concatenate([x[0] for x in parts])
    fp = np.concatenate([x[1] for x in parts])
    k = np.concatenate([np.full(len(x[0]), x[2]) for x in parts])
    if bits is not None and len(at):
        held = (bits[(fp >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (fp & np.uint64(63))) & np.uint64(1) == 1
        at, fp, k = at[held], fp[held], k[held]
    order = np.argsort(at, kind="stable")
    at, fp, k = at[order], fp[order], k[order]
    row = np.searchsorted(first, at, side="right") - 1
    lo, hi, m = first[row], first[row + 1], np.abs(k)
    reach = np.where(k > 0, window - gram, 0)
    values = pa.StructArray.from_arrays(
        [
            pa.array(k.astype(np.int32)), pa.array(tk.signed(fp)), pa.array((at - lo).astype(np.int32)),
            _around(words, np.maximum(lo, at - reach), at, -1), _around(words, at, at + m, 1), _around(words, at + m, np.minimum(hi, at + m + reach), 1),
        ],
        fields=list(_PRINT_TYPE),
    )
    return values, np.bincount(row, minlength=len(sizes))


def _scan(id_name: str, lengths: list[int], bits, whole: bool, window: int, gram: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value if bits is not None else None
        for batch in batches:
            for lo, hi, raw, bounds in tk.text_chunks(batch.column("text")):
                data = tk.LOWER[raw]
                starts, ends, first = tk.word_spans(data, bounds, tk.ALNUM)
                words = tk.span_hashes(data, starts, ends)
                values, counts = _prints(words, first, lengths, table, whole, window, gram, common)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_name).slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(np.diff(first)), tk.list_array(values, counts)],
                    names=[id_name, "text_key", "n_words", "prints"],
                )

    return run


def _common_grams(spark: SparkSession, texts: DataFrame, gram: int) -> np.ndarray:
    """Hashes of the grams that hold more than one in HOT_GRAMS of all places of texts: fewer than HOT_GRAMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, bounds in tk.text_chunks(batch.column("text")):
                data = tk.LOWER[raw]
                starts, ends, first = tk.word_spans(data, bounds, tk.ALNUM)
                grams = tk.gram_hashes(tk.span_hashes(data, starts, ends), gram)
                u, n = np.unique(grams[tk.gram_starts(first, gram)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(u)), pa.array(n.astype(np.int64))], names=["g", "n"])

    with tk.Steps(spark) as steps:
        counts = steps.store(texts.select("text").mapInArrow(tk.released(run), "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        found = counts.where(F.col("n") > max(total / HOT_GRAMS, 20)).select("g").collect()
    return np.sort(np.array([r.g for r in found], np.int64).view(np.uint64))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, spans (array of [from, to) words), item_ids (array of strings)."""
    items = items.select(F.col("item_id").alias("doc_id"), "text")
    marked = items.select(F.col("doc_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", tk.text_key())
    common = _common_grams(spark, marked, gram)
    of_items = marked.mapInArrow(_scan("item_id", list(range(1, window)), None, True, window, gram, common), f"item_id bigint, text_key bigint, n_words bigint, prints {_PRINT}")
    of_items = tk.shared_checkpoint(spark, of_items.select("item_id", F.explode("prints").alias("p")).select("item_id", "p.k", "p.fp", "p.left", "p.mid", "p.right").distinct())
    lengths = sorted(-r.k for r in of_items.where("k < 0").select("k").distinct().collect())  # window - 1 values at most
    slots = of_items.selectExpr(f"fp & {FILTER_BITS - 1} AS b").selectExpr("shiftright(b, 6) AS slot", "shiftleft(1L, cast(b & 63 AS int)) AS bit")
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for r in slots.groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toLocalIterator():  # as many rows as the table has slots at most
        bits[r.slot] = np.uint64(r.bits & (2**64 - 1))
    held = spark.sparkContext.broadcast(bits)

    scanned = tk.keyed_texts(docs).mapInArrow(tk.released(_scan("doc_id", lengths, held, False, window, gram, common)), f"doc_id bigint, text_key bigint, n_words bigint, prints {_PRINT}")
    d = scanned.select("doc_id", "text_key", "n_words", F.explode_outer("prints").alias("d")).select("doc_id", "text_key", "n_words", "d", "d.k", "d.fp")
    i = of_items.select("item_id", "k", "fp", F.struct("fp", "left", "mid", "right").alias("i"))
    if (i.agg(F.sum(tk.row_bytes(i))).first()[0] or 0) <= tk.BROADCAST_BYTES * 8:  # items of a benchmark of usual size
        joined = d.join(F.broadcast(i), ["k", "fp"], "left")
    else:
        d = tk.shared_checkpoint(spark, d)
        joined = tk.skew_join(d, i, tk.shared_checkpoint(spark, d.where("fp IS NOT NULL").groupBy("k", "fp").agg(F.count("*").alias("n"))), ["k", "fp"], "left")
    run = lambda side: F.zip_with(f"d.{side}", f"i.{side}", lambda a, b: F.coalesce(a == b, F.lit(False)))
    same = lambda side: F.when(F.array_position(run(side), F.lit(False)) == 0, F.size(run(side))).otherwise(F.array_position(run(side), F.lit(False)) - 1)
    joined = joined.withColumn("lo", F.col("d.at") - same("left")).withColumn("hi", F.col("d.at") + F.abs("d.k") + same("right"))
    good = F.col("i.fp").isNotNull() & (F.col("d.mid") == F.col("i.mid")) & ((F.col("d.k") < 0) | (F.col("hi") - F.col("lo") >= window))
    # a document's own spans and items meet in one row: both are bounded by its length
    grouped = joined.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(good, F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))))).alias("runs"),
        F.array_sort(F.collect_set(F.when(good, F.col("item_id").cast("string")))).alias("item_ids"),
    )
    union = F.aggregate(
        "runs", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["hi"]).alias("end"), (acc["total"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], acc["end"]))).alias("total")),
    )
    return grouped.select("doc_id", "text_key", "n_words", union["total"].alias("n_hit"), F.col("runs").alias("spans"), "item_ids")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item; all columns stay."""
    gone = tk.shared_checkpoint(spark, decontaminate(spark, docs, items).where("n_hit > 0").select("doc_id", "text_key"))
    return tk.without(spark, docs, gone)


OP1_SQL = rf"""
WITH dw AS (SELECT doc_id, {tk.SQL_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {tk.SQL_WORDS} AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS m FROM iw WHERE len(w) > 0),
ip AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM il),
ig AS (SELECT DISTINCT item_id, m, list_aggregate(w[p:p + m - 1], 'string_agg', ' ') AS g FROM ip),
ms AS (SELECT DISTINCT m FROM il),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, ms WHERE len(w) >= m),
dg AS (SELECT doc_id, m, p, list_aggregate(w[p:p + m - 1], 'string_agg', ' ') AS g FROM dp),
hit AS (SELECT doc_id, m, p, item_id FROM dg JOIN ig USING (m, g)),
pos AS (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS q FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN its USING (doc_id)
"""
