"""Removal of repeated byte strings by prefix-free parsing (operator 12).

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
smaller document, or earlier in the same one.

Parsing. A rolling hash is taken of every GRAM bytes. Among the first SPAN places
of every window of LENGTH bytes the place with the least hash (the leftmost of
equal ones) is a trigger, so each window holds one, and equal windows hold it at
the same place. Consecutive windows with the same trigger are one element of the
parse: its phrase (what precedes the trigger) with the look-ahead that its
windows need. Elements whose bytes are equal are one entry of the dictionary.

Corpus order. Suffixes that start in the phrase of an element are ordered by the
dictionary's suffix first and by the parse from the trigger on then; here orders
are of hashed names instead of bytes, as only this is asked of them: that
suffixes with LENGTH bytes in common stand together, the earliest first.
1. Elements are sorted by (the first bytes from the trigger on, entry, place).
   Of each entry the first element stays; in all others every window is a later
   copy. That settles the inside of all long repeats, whatever their number.
2. An entry whose beginning after the trigger no other entry shares holds no
   window that stands elsewhere. Of the others, those at the ends of repeats, the
   suffixes are sorted one by one by their first LENGTH bytes; in each interval
   the first stays. Two places with equal windows have elements of one entry, or
   of two that share the bytes after the trigger, so no pair is missed.
Names are two independent 64-bit hashes. Cutting an element in two, as between
the pieces of a very long text, moves windows from step 1 to step 2 and changes no result.

Scale. Rows are shuffled as packed arrays under bucket numbers, each task having
dropped what it saw to be a later copy. Beginnings that more than one in
HOT_SHARE elements have are counted first; their elements are dealt out by entry
instead, and all their entries go to step 2, so no bucket grows with one passage. Texts
are shuffled only for documents with an open entry or a repeat.

Nulls: a null text is empty; a null doc_id comes before all others. Ties: rows of
one id and different texts are documents apart, ordered by a hash of the text;
rows of the same id and text are one document and lose the same bytes. Texts under
LENGTH bytes lose nothing. Very long texts are parsed half a megabyte at a time. An empty
table gives an empty one. All other columns stay; those that are added give way to columns of the same name (tk.fresh).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

LENGTH = 100
GRAM = 8
#: Places parsed at once.
PIECE = 1 << 19
#: Rows that a task holds before it packs them, and about how many a bucket gets.
HELD, BUCKET = 400_000, 100_000
#: A beginning is counted if a piece holds it so many times.
_OFTEN = 8
_NO_ID = -(2**63)

ELEMENT = np.dtype([("key", "u8"), ("entry", "u8"), ("doc", "i8"), ("of", "i8"), ("at", "u4"), ("n", "u2")])
WINDOW = np.dtype([("key", "u8"), ("entry", "u8"), ("doc", "i8"), ("of", "i8"), ("at", "u4")])
RANGE = np.dtype([("doc", "i8"), ("of", "i8"), ("at", "u4"), ("to", "u4")])


def span_of(length: int) -> int:
    """Places of a window among which its trigger lies: the rest of it, GRAM bytes or more, follows the trigger."""
    if length < GRAM:
        raise ValueError(f"at least {GRAM} bytes")
    return max(1, min(length * 3 // 5, length - GRAM + 1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SEEDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BASES = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grams(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    padded = np.ascontiguousarray(data)
    eight = np.ndarray(len(padded) - GRAM + 1, dtype="<u8", buffer=padded, strides=(1,))
    return tk.mix(eight + np.uint64(_SEEDS[seed]))


class Rolling:
    """Hashes of any byte string of GRAM bytes or more within data, from running sums over its grams."""

    def __init__(self, grams: np.ndarray, seed: int) -> None:
        if len(_tables.get(seed, ((),))[0]) <= len(grams):
            size = max(PIECE + 1024, len(grams) + 1)
            _tables[seed] = (_powers(_BASES[seed], size), _powers(pow(_BASES[seed], -1, 2**64), size))
        power, self.back = _tables[seed]
        self.sums = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(grams * power[: len(grams)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tk.mix((self.sums[ends - GRAM + 1] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each span values in a row."""
    out, n = values, 1
    while 2 * n <= span:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    rest = span - n
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _pieces(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, bytes, row and start of each whole window that starts in the first PIECE places): windows end within their row."""
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    for lo in range(0, len(data), PIECE):
        hi = min(lo + PIECE, len(data))
        rows = np.arange(max(0, int(np.searchsorted(bounds, lo, side="right")) - 1), min(len(count), int(np.searchsorted(bounds, hi, side="left"))))
        first, last = np.maximum(bounds[rows], lo), np.minimum(bounds[rows] + count[rows], hi)
        n = np.maximum(last - first, 0)
        upto = np.cumsum(n)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - n), n)
        if len(at):
            yield lo, data[lo : min(hi + length, len(data))], np.repeat(rows, n), at - lo


def elements(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, at: its first window's start in the row, n: its windows, key, entry) of the parse's elements, piece by piece."""
    span = span_of(length)
    for lo, piece, row, at in _pieces(data, bounds, length):
        grams = _grams(piece, 0)
        place = np.uint64((1 << 24) - 1)
        trigger = (_least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), span)[at] & place).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(at)))
        first, of = at[head], row[head]
        key = Rolling(grams, 0).of(trigger[head], trigger[head] + length - span + 1)
        entry = Rolling(_grams(piece, 1), 1).of(first, first + n - 1 + length)
        yield of, first + lo - bounds[of], n, key, entry


def _columns(rows: np.ndarray) -> bytes:
    """The rows, column after column: equal and small values of a column lie together."""
    return b"".join(rows[name].tobytes() for name in rows.dtype.names)


def _rows(packed: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(p) for p in packed) // kind.itemsize, kind)
    done = 0
    for p in packed:
        n, at = len(p) // kind.itemsize, 0
        for name in kind.names:
            out[name][done : done + n] = np.frombuffer(p, kind[name], n, at)
            at += n * kind[name].itemsize
        done += n
    return out


def _ordered(rows: np.ndarray) -> np.ndarray:
    """rows by name, and by place within equal names."""
    return rows[np.lexsort((rows["at"], rows["of"], rows["doc"], rows["entry"], rows["key"]))]


def _split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each name, the later ones) of ordered rows; rows that are the first's equals (a repeated document) go."""
    if not len(rows):
        return rows, rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["entry"][1:] != rows["entry"][:-1])
    head = np.flatnonzero(new)
    first = rows[np.repeat(head, np.diff(np.append(head, len(rows))))]
    same = (rows["doc"] == first["doc"]) & (rows["of"] == first["of"]) & (rows["at"] == first["at"])
    return rows[head], rows[~same]


def _merged(rows: np.ndarray) -> np.ndarray:
    """Ranges that meet, as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["at"], rows["of"], rows["doc"]))]
    other = np.ones(len(rows), bool)
    other[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["of"][1:] != rows["of"][:-1])
    of = np.cumsum(other) << 33
    reach = np.maximum.accumulate(rows["to"].astype(np.int64) + of)
    new = other.copy()
    new[1:] |= rows["at"][1:].astype(np.int64) + of[1:] > reach[:-1]
    head = np.flatnonzero(new)
    out = rows[head]
    out["to"] = reach[np.append(head[1:], len(rows)) - 1] - of[head]
    return out


def _ranges(rows: np.ndarray, length: int) -> np.ndarray:
    """The bytes that later copies cover."""
    out = np.empty(len(rows), RANGE)
    out["doc"], out["of"], out["at"] = rows["doc"], rows["of"], rows["at"]
    out["to"] = rows["at"].astype(np.int64) + length + (rows["n"].astype(np.int64) - 1 if "n" in rows.dtype.names else 0)
    return _merged(out)


def _dealt(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows)."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(head, [*head[1:], len(rows)], strict=True):
        yield int(bucket[a]), rows[a:b]


def _document_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(tk.mix(rows["doc"].view(np.uint64)) + rows["of"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _name_bucket(rows: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    by = np.where(np.isin(rows["key"], hot), rows["entry"], rows["key"]) if len(hot) else rows["key"]
    return (tk.mix(by + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


_PACKED = "bucket int, names binary, ranges binary"


def _batch(out: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    bucket, names, ranges = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(names, pa.binary()), pa.array(ranges, pa.binary())], names=["bucket", "names", "ranges"])


def _packing(found: Callable[[pa.RecordBatch], Iterator[np.ndarray]], length: int, buckets: int, hot: np.ndarray):
    """What found() makes of each batch, named rows, under buckets: the first of each name in a task goes on, later ones become ranges."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        first, later = _split(_ordered(np.concatenate(held)))
        ranges = _ranges(later, length)
        out = [(b, _columns(np.sort(rows, order=["doc", "of", "at"])), b"") for b, rows in _dealt(first, _name_bucket(first, buckets, hot))]
        if len(ranges):
            out += [(b, b"", _columns(rows)) for b, rows in _dealt(ranges, _document_bucket(ranges, buckets))]
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for rows in found(batch):
                held.append(rows)
                if sum(map(len, held)) >= HELD:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _named(kind: np.dtype, batch: pa.RecordBatch, lo: int, hi: int, row: np.ndarray, **values: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), kind)
    out["doc"] = np.asarray(batch.column("doc"))[lo:hi][row]
    out["of"] = np.asarray(batch.column("of"))[lo:hi][row]
    for name, x in values.items():
        out[name] = x
    return out


def _parse(length: int):
    """The elements of each text."""

    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for lo, hi, data, bounds in tk.text_chunks(batch.column("text")):
            for row, at, n, key, entry in elements(data, bounds, length):
                yield _named(ELEMENT, batch, lo, hi, row, key=key, entry=entry, at=at, n=n)

    return found


def _suffixes(length: int):
    """The suffixes that start in each text's open elements, named by their first bytes."""

    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for lo, hi, data, bounds in tk.text_chunks(batch.column("text")):
            open_ = np.zeros(len(data) + 1, np.int32)
            for r in range(lo, hi):
                held = _rows([batch.column("open")[r].as_py()], RANGE)
                np.add.at(open_, held["at"].astype(np.int64) + bounds[r - lo], 1)
                np.add.at(open_, held["to"].astype(np.int64) + bounds[r - lo], -1)
            open_ = np.cumsum(open_)
            for off, piece, row, at in _pieces(data, bounds, length):
                keep = open_[at + off] > 0
                row, at = row[keep], at[keep]
                if len(at):
                    names = [Rolling(_grams(piece, seed), seed).of(at, at + length) for seed in (0, 1)]
                    yield _named(WINDOW, batch, lo, hi, row, key=names[0], entry=names[1], at=at + off - bounds[row])

    return found


def _settled(kind: np.dtype, length: int, buckets: int, hot: np.ndarray):
    """A bucket's names in order: ranges of later copies by document bucket, and (names) the first elements of entries that share their beginning."""

    def run(table: pa.Table) -> pa.Table:
        first, later = _split(_ordered(_rows(table.column("names").to_pylist(), kind)))
        ranges = _merged(np.concatenate([_ranges(later, length), _rows(table.column("ranges").to_pylist(), RANGE)]))
        out = [(b, b"", _columns(rows)) for b, rows in _dealt(ranges, _document_bucket(ranges, buckets))]
        if "n" in kind.names and len(first):
            shared = np.isin(first["key"], hot)
            shared[1:] |= first["key"][1:] == first["key"][:-1]
            shared[:-1] |= first["key"][1:] == first["key"][:-1]
            some = first[shared]
            open_ = np.empty(len(some), RANGE)
            open_["doc"], open_["of"], open_["at"], open_["to"] = some["doc"], some["of"], some["at"], some["at"] + some["n"]
            out += [(b, _columns(rows), b"") for b, rows in _dealt(open_, _document_bucket(open_, buckets))]
        return pa.Table.from_batches([_batch(out)])

    return run


def _by_document(packed: DataFrame, column: str, joined: bool) -> DataFrame:
    """doc, of, ranges: a document's ranges, ascending and (if joined) apart."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table.column(column).to_pylist(), RANGE)
        rows = _merged(rows) if joined else rows[np.lexsort((rows["at"], rows["of"], rows["doc"]))]
        head = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["of"][1:] != rows["of"][:-1]))) if len(rows) else np.zeros(0, int)
        ends = np.append(head[1:], len(rows))
        return pa.table({"doc": pa.array(rows["doc"][head]), "of": pa.array(rows["of"][head]), "ranges": pa.array([_columns(rows[a:b]) for a, b in zip(head, ends, strict=True)] if len(rows) else [], pa.binary())})

    return packed.where(F.octet_length(column) > 0).select("bucket", column).groupBy("bucket").applyInArrow(run, "doc bigint, of bigint, ranges binary")


def _counted(length: int):
    """(null, all elements) and (key, n) of beginnings that stand in one piece often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for _, _, data, bounds in tk.text_chunks(batch.column("text")):
                for _, _, _, key, _ in elements(data, bounds, length):
                    total += len(key)
                    value, n = np.unique(key, return_counts=True)
                    often = n >= _OFTEN
                    if often.any():
                        yield pa.RecordBatch.from_arrays([pa.array(tk.signed(value[often])), pa.array(n[often])], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["key", "n"])

    return run


def _documents(docs: DataFrame) -> DataFrame:
    keyed = tk.keyed_texts(docs)
    return keyed.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.col("text_key").alias("of"), "text")


def _is(docs: DataFrame, doc: str, of: str) -> Column:
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col(doc)) & (tk.text_key() == F.col(of))


def later_strings(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc (the id, or the least long for null), of (text_key), ranges (packed RANGE rows): what goes of each document that loses bytes. A stored table."""
    texts = _documents(docs)
    with tk.Steps(spark) as steps:
        counts = texts.select("text").mapInArrow(tk.released(_counted(length)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        counts = steps.store(counts)
        total = counts.where("key IS NULL").agg(F.sum("n")).first()[0] or 0
        buckets = max(1, -(-total // BUCKET))
        # fewer than 2 * HOT_SHARE keys: a key's count here falls short of the truth by _OFTEN a piece at most
        hot = np.array([r.key for r in counts.where(F.col("key").isNotNull() & (F.col("n") > max(_OFTEN, total // (2 * tk.HOT_SHARE)))).select("key").collect()], np.int64).view(np.uint64)
        parsed = texts.mapInArrow(tk.released(_packing(_parse(length), length, buckets, hot)), _PACKED)
        settled = steps.store(parsed.groupBy("bucket").applyInArrow(_settled(ELEMENT, length, buckets, hot), _PACKED))
        open_ = steps.store(_by_document(settled, "names", False))
        keys = open_.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), F.col("of").alias("text_key"))
        some, _ = tk.parts(spark, tk.keyed_texts(docs).select("doc_id", "text"), keys)
        some = some.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), tk.text_key().alias("of"), "text").join(tk.merged(open_.withColumnRenamed("ranges", "open")), ["doc", "of"])
        none = np.zeros(0, np.uint64)
        ends = some.mapInArrow(tk.released(_packing(_suffixes(length), length, buckets, none)), _PACKED)
        copies = steps.store(ends.groupBy("bucket").applyInArrow(_settled(WINDOW, length, buckets, none), _PACKED))
        return steps.keep(_by_document(settled.select("bucket", "ranges").unionByName(copies.select("bucket", "ranges")), "ranges", True))


def _cut(text: str, ranges: str):
    """kept (bytes), n_removed, n_spans of rows with text and ranges; null ranges remove nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tk.text_chunks(batch.column(text)):
                kept, removed, spans = [], [], []
                for r in range(lo, hi):
                    own, packed = data[bounds[r - lo] : bounds[r - lo + 1]], batch.column(ranges)[r].as_py()
                    rows = _rows([packed] if packed else [], RANGE)
                    stay = np.concatenate([[0], *zip(rows["at"], rows["to"], strict=True), [len(own)]]).astype(np.int64)
                    kept.append(b"".join(own[a:b].tobytes() for a, b in zip(stay[::2], stay[1::2], strict=True)))
                    removed.append(len(own) - len(kept[-1]))
                    spans.append(len(rows))
                part = batch.slice(lo, hi - lo)
                more = [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != ranges), *more], names=[*(c for c in part.schema.names if c != ranges), "", "", ""])

    return run


def drop_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, kept: str = "kept", removed: str = "n_removed", spans: str = "n_spans") -> DataFrame:
    """docs with what is left of each text's bytes (kept: binary, as a cut may fall within a character), how many went, and in how many runs."""
    kept, removed, spans = tk.fresh(docs, kept, removed, spans)
    gone = later_strings(spark, docs, length)
    doc, of, ranges = tk.fresh(docs, "of_doc", "of_text", "of_ranges")
    some, rest = tk.parts(spark, docs, gone.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), F.col("of").alias("text_key")))
    named = gone.select(F.col("doc").alias(doc), F.col("of").alias(of), F.col("ranges").alias(ranges))
    joined = some.join(tk.merged(named), _is(docs, doc, of), "left").drop(doc, of)
    more = f"`{kept}` binary, `{removed}` bigint, `{spans}` bigint"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), more])
    cut = joined.mapInArrow(tk.released(_renamed(_cut("text", ranges), [*docs.columns, kept, removed, spans])), schema)
    whole = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return cut.unionAll(rest.withColumns({kept: whole, removed: F.lit(0).cast("long"), spans: F.lit(0).cast("long")}))


def _renamed(run, names: list[str]):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return named


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(spark, tk.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_SQL_PIECE = 100

#: Every string of LENGTH bytes by its first place; bytes as two hex digits each. Strings are cut from short pieces of the text, which is faster.
OP12_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, lower(to_hex(encode(coalesce(text, '')))) AS hex FROM documents),
v AS (SELECT doc_id, start, hex[2 * start + 1 : 2 * start + {2 * (_SQL_PIECE + LENGTH - 1)}] AS part FROM (SELECT doc_id, hex, unnest(range(0, len(hex) // 2, {_SQL_PIECE})) AS start FROM d)),
w AS (SELECT doc_id, start + i AS p, md5_number(part[2 * i + 1 : 2 * i + {2 * LENGTH}]) AS h FROM (SELECT doc_id, start, part, unnest(range(0, least({_SQL_PIECE}, len(part) // 2 - {LENGTH - 1}))) AS i FROM v WHERE len(part) >= {2 * LENGTH})),
f AS (SELECT h, min((doc_id, p)) AS first FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT w.doc_id, w.p FROM w JOIN f USING (h) WHERE (w.doc_id, w.p) <> f.first),
s AS (SELECT doc_id, p, sum(CASE WHEN p <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span
      FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{LENGTH + 1}) AS before FROM c)),
r AS (SELECT doc_id, span, min(p) AS lo, max(p) + {LENGTH} AS hi FROM s GROUP BY doc_id, span),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
g AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, list((before, lo) ORDER BY lo) AS stay, max(hi) AS last FROM k GROUP BY doc_id)
SELECT d.doc_id, len(hex) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(array_to_string(list_transform(stay, lambda x: hex[2 * x[1] + 1 : 2 * x[2]]), ''), '') || hex[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
