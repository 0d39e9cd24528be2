"""Vector code compression by product quantization, with Elkan's form of Lloyd's rounds (operator 13).

A vector is cut into parts, and each part position has a codebook of entries;
a vector's code holds, for each part, the number of its nearest entry. Vectors
and codebooks are integers, so that distances, ties and means are exact.

Between rounds a table keeps, for each vector and part, the assigned entry, an
upper bound of the distance to it, and a lower bound of the distance to each
entry. A round skips an entry if by the triangle inequality it is strictly
farther than the assigned one: its lower bound, or half the distance between
the two entries, exceeds the upper bound; a part that lies within half the way
from its entry to the closest other one is skipped whole. What isn't skipped is
measured exactly, and equal distances go to the lower index. After an update
the bounds are shifted by how far each entry moved. Bounds are rounded away from
the truth (upper ones up, lower ones down), so rounding can only cost a
measurement, never change an assignment; lower bounds are kept in two bytes.

Sums for the update are added up in each task and then by entry; only codebooks
and these sums, both of constant size, pass through the driver. Each round's
table is written before the next reads it, and the one before deleted.

Nulls: rows whose vector is null, or holds null or non-finite components, are
left out, and so are vectors shorter than the longest (they lack components); a
null label is a label of its own; a null id comes last among those that give the
first entries. Ties: ids that are equal are ordered by their vectors; repeated
rows count and are returned each. With fewer vectors than entries the codebook
has as many entries as there are vectors. An empty table gives an empty one. Other
columns, whatever their names, are not looked at. Vectors of any length are
whole; the length must be a multiple of the number of parts, and components must
be under MOST in magnitude after scaling, so that sums of squares are exact (else ValueError).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Scaled components are less than this.
MOST = 1 << 26
#: Distances measured at once in a task.
_CELLS = 1 << 20

_STATE = "vec_id bigint, label int, vector binary, code binary, upper binary, lower binary"


class Codebooks(NamedTuple):
    """entries: part, entry, component. unit: one step of the lower bounds, by part. moved: how far each entry came in the last update."""

    entries: np.ndarray
    unit: np.ndarray
    moved: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_vectors(table: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label, vector (integers: floor(SCALE * x)) of the rows whose vector is complete and finite."""
    x = F.col("v")
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(sound)
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if size % PARTS:
        raise ValueError(f"vectors have {size} components, not a multiple of {PARTS}")
    far = F.exists(x, lambda c: F.abs(c) * SCALE >= MOST)
    ints = F.when(far, F.raise_error(F.lit(f"a component is {MOST // SCALE} or more"))).otherwise(F.transform(x, lambda c: F.floor(c * SCALE).cast("int")))
    return rows.where(F.size("v") == size).select("vec_id", "label", ints.cast("array<int>").alias("vector"))


def _down(x: np.ndarray) -> np.ndarray:
    """x, a little less than the truth; _up: a little more."""
    return np.maximum(x * (1 - 1e-12) - 1e-9, 0)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12) + 1e-9


def _squares(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand opposite each other."""
    apart = vectors - entries
    return np.einsum("ij,ij->i", apart, apart)


def _first(books: Codebooks, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of vectors that have no bounds yet: everything is measured."""
    entries = books.entries[part]
    code, upper, lower = np.zeros(len(x), np.uint8), np.zeros(len(x)), np.zeros((len(x), len(entries)), np.uint16)
    step = max(1, _CELLS // max(1, entries.size))
    for lo in range(0, len(x), step):
        apart = x[lo : lo + step, None, :] - entries[None, :, :]
        square = np.einsum("ijk,ijk->ij", apart, apart)
        code[lo : lo + step] = square.argmin(axis=1)  # the lower index of equal ones
        away = np.sqrt(square.astype(np.float64))
        upper[lo : lo + step] = _up(away.min(axis=1))
        lower[lo : lo + step] = _steps(books, part, away)
    return code, upper, lower


def _steps(books: Codebooks, part: int, away: np.ndarray) -> np.ndarray:
    """Lower bounds in whole steps, the greatest that two bytes hold at most."""
    return np.minimum(np.floor(_down(away) / books.unit[part]), 65535).astype(np.uint16)


def _again(books: Codebooks, part: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round over vectors with bounds; and how many distances were measured."""
    entries, moved, unit = books.entries[part], books.moved[part], books.unit[part]
    upper = _up(upper + moved[code])
    lower = np.maximum(lower.astype(np.int32) - np.ceil(_up(moved) / unit).astype(np.int32)[None, :], 0).astype(np.uint16)
    apart = entries[:, None, :] - entries[None, :, :]
    half = _down(np.sqrt(np.einsum("ijk,ijk->ij", apart, apart).astype(np.float64))) / 2
    np.fill_diagonal(half, np.inf)
    code, measured = code.copy(), 0
    open_ = np.flatnonzero(upper >= half.min(axis=1)[code])
    # first with the upper bound that is at hand, then with the distance itself
    open_ = open_[_candidates(books, part, open_, code, upper, lower, half).any(axis=1)] if len(open_) else open_
    own = _squares(x[open_], entries[code[open_]])
    measured += len(open_)
    upper[open_] = _up(np.sqrt(own.astype(np.float64)))
    step = max(1, _CELLS // max(1, entries.size))
    for lo in range(0, len(open_), step):
        rows = open_[lo : lo + step]
        at, entry = np.nonzero(_candidates(books, part, rows, code, upper, lower, half))
        if not len(at):
            continue
        square = _squares(x[rows[at]], entries[entry])
        measured += len(at)
        lower[rows[at], entry] = _steps(books, part, np.sqrt(square.astype(np.float64)))
        # of the assigned entry and the measured ones: the least square, then the lower index
        who = np.concatenate([np.arange(len(rows)), at])
        which = np.concatenate([code[rows].astype(np.int64), entry])
        far = np.concatenate([own[lo : lo + step], square])
        order = np.lexsort((which, far, who))
        best = order[np.searchsorted(who[order], np.arange(len(rows)))]
        old = code[rows]
        lower[rows, old] = _steps(books, part, np.sqrt(own[lo : lo + step].astype(np.float64)))
        code[rows] = which[best]
        upper[rows] = _up(np.sqrt(far[best].astype(np.float64)))
    return code, upper, lower, measured


def _candidates(books: Codebooks, part: int, rows: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Entries that may be as near as the assigned one: not strictly farther by either bound."""
    u, own = upper[rows][:, None], code[rows]
    maybe = (lower[rows] * books.unit[part] <= u) & (half[own] <= u)
    maybe[np.arange(len(rows)), own] = False
    return maybe


def _assigned(books: Codebooks, fresh: bool):
    """Vectors (and, unless fresh, their state) to their state under these codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, m = books.entries.shape
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            held = lambda name, kind, shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(shape)  # noqa: B023, E731
            x = held("vector", np.int32, (n, parts, m)).astype(np.int64)
            code, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts, k), np.uint16)
            for p in range(parts):
                if fresh:
                    code[:, p], upper[:, p], lower[:, p] = _first(books, p, x[:, p])
                else:
                    was = (held("code", np.uint8, (n, parts))[:, p], held("upper", np.float64, (n, parts))[:, p], held("lower", np.uint16, (n, parts, k))[:, p])
                    code[:, p], upper[:, p], lower[:, p], _ = _again(books, p, x[:, p], *was)
            bytes_ = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), bytes_(code), bytes_(upper), bytes_(lower)], names=["vec_id", "label", "vector", "code", "upper", "lower"])

    return run


def _sums(shape: tuple[int, int, int]):
    """part, entry, n, sums of the vectors of one task, by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, m = shape
        total, count = np.zeros((parts * k, m), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).reshape(len(batch), parts, m)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), parts)
            for p in range(parts):
                at = code[:, p].astype(np.int64) + p * k
                np.add.at(total, at, x[:, p])
                count += np.bincount(at, minlength=parts * k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array((some // k).astype(np.int32)), pa.array((some % k).astype(np.int32)), pa.array(count[some]), tk.list_array(pa.array(total[some].reshape(-1)), np.full(len(some), m))], names=["part", "entry", "n", "sums"]
        )

    return run


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of its vectors; unused ones stay. What reaches the driver has a row for each entry."""
    parts, k, m = books.entries.shape
    sums = state.select("vector", "code").mapInArrow(tk.released(_sums((parts, k, m))), "part int, entry int, n bigint, sums array<bigint>")
    added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(m)]).alias("sums"))
    entries = books.entries.copy()
    for r in added.collect():
        entries[r.part, r.entry] = [s // r.n for s in r.sums]
    moved = np.sqrt(np.square(entries - books.entries).sum(axis=2).astype(np.float64))
    return books._replace(entries=entries, moved=_up(moved) * (moved > 0))


def _start(vectors: DataFrame) -> Codebooks | None:
    """The first entries: the vectors of the smallest ids. None if there are no vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()  # ENTRIES rows
    if not first:
        return None
    x = np.array([r.vector for r in first], np.int64).reshape(len(first), PARTS, -1)
    entries = np.ascontiguousarray(x.transpose(1, 0, 2))
    apart = entries[:, :, None, :] - entries[:, None, :, :]
    widest = np.sqrt(np.square(apart).sum(axis=3).astype(np.float64)).reshape(PARTS, -1).max(axis=1)
    # two bytes reach twice as far as the entries are apart; what lies beyond counts as that far
    return Codebooks(entries, np.maximum(widest, 1) / 32767, np.zeros(entries.shape[:2]))


def fit(spark: SparkSession, vectors: DataFrame, steps: tk.Steps, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """(state of every vector under the final codebooks: vec_id, label, vector, code, upper, lower; the codebooks) of vectors from whole_vectors(). None without vectors."""
    vectors = steps.store(vectors)
    books = _start(vectors)
    if books is None:
        return None
    raw = vectors.select("vec_id", "label", "vector").mapInArrow(tk.released(_packed), "vec_id bigint, label int, vector binary")
    state = steps.store(raw.mapInArrow(tk.released(_assigned(books, True)), _STATE))
    for _ in range(rounds):
        books = _updated(state, books)
        before, state = state, steps.store(state.mapInArrow(tk.released(_assigned(books, False)), _STATE))
        steps.drop(before)
    return state, books


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of 32-bit integers."""
    for batch in batches:
        lists = batch.column("vector")
        values = np.asarray(lists.flatten()).astype(np.int32).reshape(len(batch), -1)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in values], pa.binary())], names=["vec_id", "label", "vector"])


def _errors(books: Codebooks):
    """vec_id, label, code (bytes), error: exact squared distances, summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, m = books.entries.shape
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).reshape(len(batch), parts, m).astype(np.int64)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), parts)
            error = sum((_squares(x[:, p], books.entries[p, code[:, p]]) for p in range(parts)), np.zeros(len(batch), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress(spark: SparkSession, table: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code: a byte for each part, error; the codebooks), a row for each complete vector of table. A stored table."""
    with tk.Steps(spark) as steps:
        fitted = fit(spark, whole_vectors(table, vector, key, label), steps)
        if fitted is None:
            return spark.createDataFrame([], "vec_id bigint, label int, code binary, error bigint"), None
        state, books = fitted
        return steps.keep(state.select("vec_id", "label", "vector", "code").mapInArrow(tk.released(_errors(books)), "vec_id bigint, label int, code binary, error bigint")), books


def restore(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with vector: the entries that their codes name, scaled back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, m = books.entries.shape
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), parts)
            x = books.entries[np.arange(parts)[None, :], code].reshape(len(batch), -1) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, tk.list_array(pa.array(x.reshape(-1)), np.full(len(batch), parts * m))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(tk.released(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in codes.schema.fields) + ", vector array<double>")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark, tk.table(spark, sf_dir, "embeddings"))
    by = F.coalesce(F.col("label").cast("string"), F.lit("-"))  # nulls together
    rows = codes.withColumn("of", by)
    sums = tk.shared_checkpoint(spark, rows.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = tk.skew_join(rows, sums.select("of", "label_error"), sums.select("of", "n"), ["of"])
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd's rounds in full: every distance of every round."""
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(x * {SCALE})::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"u AS MATERIALIZED (SELECT row, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS x FROM v, range({PARTS}) r(p))",
        f"f AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v QUALIFY e < {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT p, e, x FROM u JOIN f USING (row))",
    ]
    square = "list_sum(list_transform(list_zip(u.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT row, p, min(struct_pack(d := {square}, e := e)) AS c FROM u JOIN b{r} b USING (p) GROUP BY row, p)")
        if r < ROUNDS:
            out.append(f"s{r} AS (SELECT p, c.e AS e, i, sum(x[i + 1])::BIGINT AS s, count(*) AS n FROM a{r} JOIN u USING (row, p), range(64) g(i) WHERE i < len(x) GROUP BY ALL)")
            out.append(f"m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY p, e)")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))")
    return f"""
WITH {', '.join(out)},
k AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
q AS (SELECT row, string_agg(lpad(lower(to_hex(c.e)), 2, '0'), '' ORDER BY p) AS code, sum(c.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM q JOIN v USING (row), k
"""


#: Of vectors of 256 components at most (four parts of 64).
OP13_SQL = _sql()
