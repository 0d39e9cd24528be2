"""Array-at-a-time text handling shared by the corpus operators.

Everything here works on the raw UTF-8 bytes of an Arrow string column, a few
megabytes at a time, so that memory in a Python worker is bounded by the chunk
(or by the one longest text) and no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_BYTES, HOT_SHARE, fresh, merged, row_bytes, skew_join, small  # noqa: F401
from ..operators.storage import delete, stored

#: Bytes of text handled at once; a longer single text forms a chunk alone.
CHUNK_BYTES = 1 << 21
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000
#: 8-byte pieces that are hashed at once, unless one span has more.
_PIECES = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.arange(256)
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every non-ASCII byte.
ALNUM = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
#: Bytes of [^\x20\x09-\x0D].
SOLID = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))

_ROOT = str(Path(__file__).resolve().parents[2])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values: spreads entropy over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back the memory that is free in the worker when its task ends: workers live on for later tasks and stages.

    Rows reach it BATCH_ROWS at a time: batches of texts lie in memory several times, in the JVM and in the worker.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return whole


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for runs of rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of bytes in table, none across rows; row r has words first[r]:first[r+1]."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans, equal hashes. Hashes by other seeds are independent.

    A span is cut into pieces of eight bytes; each is mixed with a key of its
    place, and the sum is mixed with the length. Mixing is no ring operation, so
    no pair of byte strings collides by its structure, whatever the seed.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    pieces = np.maximum((sizes + 7) >> 3, 1)
    upto = np.concatenate([[0], np.cumsum(pieces)])
    secret = mix(np.array([seed + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PIECES, side="right")) - 1)
        count = pieces[lo:hi]
        first = upto[lo:hi] - upto[lo]
        place = np.arange(int(upto[hi] - upto[lo]), dtype=np.int64) - np.repeat(first, count)
        left = np.repeat(sizes[lo:hi], count) - (place << 3)
        value = eight[np.repeat(starts[lo:hi], count) + (place << 3)]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short] << 3).astype(np.uint64)) - np.uint64(1)
        keyed = mix(value + mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + secret))
        out[lo:hi] = mix(np.add.reduceat(keyed, first) + sizes[lo:hi].astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + secret)
        lo = hi
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes, rows ignored: len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h + np.uint64(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of words that begin k words of one row."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(ends), dtype=np.int64)
    return at[at + k <= ends]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def text_key() -> Column:
    """With doc_id it names a row by what it holds; repeated rows share it. Null text has a key of its own."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key only, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key())


#: Rows of the table that parts() joins to: 64 bits each, 512 kB in all, whatever the number of keys.
_WORDS = 1 << 16


def parts(spark: SparkSession, docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs that keys (doc_id, and text_key if it is there) may name, docs that it surely doesn't): so that a join moves the texts of the former only.

    A table of bits, of a fixed size, is broadcast; a few rows that no key names fall in the first part too.
    """
    whole = "text_key" in keys.columns
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(_WORDS * 64))
    at, word, bits, bit = fresh(docs, "slot_at", "slot_word", "slot_bits", "slot_bit")
    marks = keys.select(slot(F.col("doc_id").cast("long"), *([F.col("text_key")] if whole else [])).alias(at)).select(F.shiftright(at, 6).alias(word), F.expr(f"shiftleft(1L, cast({at} & 63 AS int))").alias(bits))
    table = F.broadcast(marks.groupBy(word).agg(F.expr(f"bit_or({bits})").alias(bits)))
    marked = docs.withColumn(at, slot(F.col("doc_id").cast("long"), *([text_key()] if whole else []))).withColumn(word, F.shiftright(at, 6)).join(table, word, "left")
    marked = marked.withColumn(bit, F.coalesce(F.expr(f"shiftright({bits}, cast({at} & 63 AS int)) & 1"), F.lit(0)))
    same = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(f"{bit} = 1").select(*same), marked.where(f"{bit} = 0").select(*same)


def named(docs: DataFrame, by_id: str, by_key: str) -> Column:
    """Whether columns by_id and by_key name the row of docs."""
    return F.col("doc_id").cast("long").eqNullSafe(F.col(by_id)) & (text_key() == F.col(by_key))


def without(spark: SparkSession, docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows that gone (doc_id, text_key; a stored table) names; all columns stay. Texts of rows that gone doesn't name aren't shuffled."""
    by_id, by_key = fresh(docs, "gone_id", "gone_key")
    some, rest = parts(spark, docs, gone)
    gone = gone.select(F.col("doc_id").alias(by_id), F.col("text_key").alias(by_key)).distinct()
    return some.join(merged(gone), named(docs, by_id, by_key), "left_anti").unionAll(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table. Also lets Python workers find this package where the driver has it, whatever their working folder."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Steps:
    """Tables that an operator writes on its way. Leaving the block deletes all but those that were kept.

        with Steps(spark) as steps:
            a = steps.store(df)
            return steps.keep(result)
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def store(self, df: DataFrame) -> DataFrame:
        """df written and read again: lineage ends here."""
        out, path = stored(self.spark, df)
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again, before the block ends."""
        for path in self._of(tables):
            self.paths.remove(path)
            delete(self.spark, path)

    def hold(self, *tables: DataFrame) -> None:
        """These outlive the block: a result that isn't computed yet reads them."""
        for path in self._of(tables):
            self.paths.remove(path)

    def _of(self, tables: tuple[DataFrame, ...]) -> list[str]:
        names = {file.rsplit("/", 2)[-2] for t in tables for file in t.inputFiles()[:1]}
        return [x for x in self.paths if x.rsplit("/", 1)[-1] in names]

    def keep(self, df: DataFrame) -> DataFrame:
        return stored(self.spark, df)[0]


def shared_checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read from there."""
    return stored(spark, df)[0]


#: SQL of the words of column text, for DuckDB.
SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = rf"coalesce(regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
