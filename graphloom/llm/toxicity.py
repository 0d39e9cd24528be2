"""Toxicity by maximum-scoring segments (operator 3).

Words get log-odds between toxic and other documents under a Dirichlet prior
made of their counts in all documents; words whose log-odds are significant
form the lexicon. In a text, lexicon words score their log-odds and all other
words a small penalty; the linear-time scan of Ruzzo and Tompa finds every
maximal-scoring passage. By Karlin and Altschul's extreme-value law the best
score of n words of chance exceeds s about n * exp(-lambda * s) times, which
turns scores of passages of any length into one measure, log(sum of
exp(lambda * s)) - log(n); a logistic curve over it, fitted on the training
rows, gives the score from 0 to 1.

Counts are of the documents that hold a word, copies and near copies of a
labelled text counting once: those with the same label whose least hashes of
five words under COPY_HASHES orders are all the same (texts that share half of
them pass in one of 256 cases, and in less where they share one passage only).
The lexicon is a table, joined to the words of texts that a bit table of fixed
size lets through, and has as many words as pass the tests below.

Nulls: a null text is empty and gets the score of a text of one harmless word;
labelled rows without an id or label are not used. Texts of any length are
scored whole, in time that grows with their words. Of several labels of an id
the greatest counts. Repeated rows are kept. Ties: equal segments stay apart, as
the scan's definition has it. Without both labels in training, every score is
the share of toxic ones. An empty table gives an empty one. Columns other than
doc_id, text and toxic, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

PRIOR_MASS = 500.0
PRIOR_FLOOR = 0.5
#: Least significance (in standard deviations) and number of toxic documents of a lexicon word.
MIN_Z, MIN_DOCS = 3.0, 3
#: Least log-odds of one: longer documents hold more of every word, which alone makes small odds significant.
MIN_ODDS = 2.0
#: Bytes of a word's stem: longer words count and score under it too, so that one form of a word speaks for another.
STEM = 5
SHINGLE = 5
COPY_HASHES = 8
FILTER_BITS = 1 << 23
BIN = 0.25

_ORDERS = np.random.default_rng(5).integers(1, 2**63, COPY_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _words(batch: pa.RecordBatch, stems: bool = False):
    """Row from, row to, word hashes, first word of each row, and hashes of the words' stems (0: none)."""
    for lo, hi, raw, bounds in tk.text_chunks(batch.column("text")):
        data = tk.LOWER[raw]
        starts, ends, first = tk.word_spans(data, bounds, tk.ALNUM)
        cut = np.where(ends - starts > STEM, tk.span_hashes(data, starts, np.minimum(ends, starts + STEM), 2), np.uint64(0)) if stems else None
        yield lo, hi, tk.span_hashes(data, starts, ends), first, cut


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, and a key that copies share, and near copies mostly."""
    for batch in batches:
        for lo, hi, words, first, _ in _words(batch):
            grams = tk.gram_hashes(words, SHINGLE)
            keys = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else tk.mix(words[a:b].cumsum(dtype=np.uint64)[-1:])
                least = np.array([(own * order).min() for order in _ORDERS]) if len(own) else _ORDERS
                keys.append(int(tk.mix(least * _ORDERS).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(keys, pa.int64())], names=["doc_id", "near"])


class _Tally:
    """Counts of word hashes in three columns, merged as it grows."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((h, n))
        self.rows += len(h)

    def merge(self) -> int:
        h = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        n = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros((0, 3), np.int64)
        u, inverse = np.unique(h, return_inverse=True)
        total = np.zeros((len(u), 3), np.int64)
        for c in range(3):
            total[:, c] = np.bincount(inverse, weights=n[:, c], minlength=len(u))
        self.parts, self.rows = [(u, total)], len(u)
        return len(u)

    def batch(self) -> pa.RecordBatch:
        self.merge()
        (u, n), self.parts, self.rows = self.parts[0], [], 0
        return pa.RecordBatch.from_arrays([pa.array(tk.signed(u)), *[pa.array(n[:, c]) for c in range(3)]], names=["word", "n_toxic", "n_clean", "n_all"])


def _count(bits):
    """Documents that hold each word: toxic, clean and all; bits: the words to count (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tally = (bits.value if bits is not None else None), _Tally()
        for batch in batches:
            toxic = np.array([-1 if x is None else x for x in batch.column("toxic").to_pylist()], np.int64)
            for lo, _, words, first, stems in _words(batch, True):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                long = stems != 0
                words, row = np.concatenate([words, stems[long]]), np.concatenate([row, row[long]])
                if table is not None:
                    held = _held(table, words)
                    words, row = words[held], row[held]
                order = np.lexsort((words, row))
                words, row = words[order], row[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
                words, label = words[new], toxic[lo + row[new]]
                tally.add(words, np.stack([label == 1, label == 0, np.ones(len(words), bool)], axis=1).astype(np.int64))
                if tally.rows > 400_000 and tally.merge() > 200_000:
                    yield tally.batch()
        yield tally.batch()

    return run


def segments(at: np.ndarray, scores: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to, score) of a text whose words score -penalty but for those at `at` (ascending)."""
    out: list[tuple[int, int, float, float, int]] = []  # from, to, sum before, sum up to its end, nearest earlier one with a lesser sum before
    total, before = 0.0, -1
    for p, s in zip(at.tolist(), scores.tolist(), strict=True):
        total -= penalty * (p - before - 1)
        start, left = p, total
        total += s
        before = p
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((start, p + 1, left, total, j))
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - x) for a, b, x, r, _ in out]


class Model:
    """A lexicon (a stored table of word and score), the penalty of other words, lambda, and the logistic curve."""

    def __init__(self, lexicon: DataFrame | None, penalty: float, lam: float) -> None:
        self.lexicon, self.penalty, self.lam = lexicon, penalty, lam
        self.slope, self.offset = 0.0, 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -50, 50)))


def _bit_table(spark: SparkSession, words: DataFrame) -> object:
    """A broadcast table of FILTER_BITS bits (1 MB packed) of words (word)."""
    slots = words.selectExpr(f"word & {FILTER_BITS - 1} AS b").selectExpr("shiftright(b, 6) AS slot", "shiftleft(1L, cast(b & 63 AS int)) AS bit").groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits"))
    packed = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in slots.toLocalIterator():  # as many rows as the table has slots at most
        packed[r.slot] = np.uint64(r.bits & (2**64 - 1))
    return spark.sparkContext.broadcast(packed)


def _held(packed: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = _slots(words)
    return (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


_PASSAGES = "array<struct<from:bigint,to:bigint,score:double>>"


def _measured(spark: SparkSession, texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """For each row of texts: its columns in keep, x (the measure), and passages with an expected number under one."""
    bits = _bit_table(spark, model.lexicon)
    numbered = texts.select("text", *keep).withColumn("row", F.monotonically_increasing_id())
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first, stems in _words(batch, True):
                whole, cut = np.flatnonzero(_held(bits.value, words)), np.flatnonzero((stems != 0) & _held(bits.value, stems))
                at, tokens = np.concatenate([whole, cut]), np.concatenate([words[whole], stems[cut]])
                order = np.argsort(at, kind="stable")
                at, tokens = at[order], tokens[order]
                row = np.searchsorted(first, at, side="right") - 1
                hits = pa.StructArray.from_arrays([pa.array(at - first[row]), pa.array(tk.signed(tokens))], names=["at", "word"])
                own = [batch.column(c).slice(lo, hi - lo) for c in ("row", *keep)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first)), tk.list_array(hits, np.bincount(row, minlength=hi - lo))], names=["row", *keep, "n_words", "hits"])

    scanned = numbered.mapInArrow(tk.released(scan), f"row bigint, {', '.join(kept)}, n_words bigint, hits array<struct<at:bigint,word:bigint>>")
    hits = scanned.select("row", *keep, "n_words", F.explode_outer("hits").alias("h")).select("row", *keep, "n_words", "h.at", "h.word")
    known = hits.join(tk.small(model.lexicon.select("word", "score")), "word", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("at", "score"))))
    grouped = known.groupBy("row").agg(*[F.first(c).alias(c) for c in (*keep, "n_words")], found.alias("found"))
    penalty, lam = model.penalty, model.lam

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            n = batch.column("n_words").to_numpy()
            x, listed = -np.log(np.maximum(n, 1)), []
            found = batch.column("found")
            for r, size in enumerate(found.value_lengths().to_numpy()):
                segs = []
                if size:
                    own = found[r].values
                    at, score = own.field("at").to_numpy(), own.field("score").to_numpy()
                    last = np.append(at[1:] != at[:-1], True)  # a word that scores by its stem too: the greater score
                    segs = segments(at[last], score[last], penalty)
                    x[r] += np.logaddexp.reduce([lam * s for _, _, s in segs])
                listed.append([{"from": a, "to": b, "score": s} for a, b, s in segs if lam * s > np.log(n[r])])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(x), pa.array(listed, kind)], names=[*keep, "x", "passages"])

    return grouped.mapInArrow(measure, f"{', '.join(kept)}, x double, passages {_PASSAGES}")


def _logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """(slope >= 0, offset) of the curve through counts at x, by Newton steps with a little ridge."""
    w = np.array([0.1, np.log((toxic.sum() + 0.5) / (clean.sum() + 0.5))])
    n = toxic + clean
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -50, 50)))
        g = np.array([((p * n - toxic) * x).sum() + 0.01 * w[0], (p * n - toxic).sum() + 0.01 * w[1]])
        v = n * p * (1 - p)
        hess = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, use: Column) -> Model:
    """The model from the rows of labels (doc_id, toxic) where use holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with tk.Steps(spark) as steps:
        marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & use).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        marked = steps.store(marked)
        near = tk.parts(spark, texts, marked)[0].mapInArrow(tk.released(_copy_keys), "doc_id bigint, near bigint").join(tk.merged(marked), "doc_id")
        once = steps.store(near.groupBy("near", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"))
        n_toxic, n_clean = (once.where(f"toxic = {v}").count() for v in (1, 0))
        if not n_toxic or not n_clean:
            model = Model(None, 1.0, 1.0)
            model.offset = 50.0 if n_toxic else -50.0
            return model
        # the texts of labelled rows are stored once; others are read where they are
        some, rest = tk.parts(spark, texts, once)
        labelled = steps.store(some.join(tk.merged(once), "doc_id", "left"))
        counts = "word bigint, n_toxic bigint, n_clean bigint, n_all bigint"
        sums = [F.sum(c).alias(c) for c in ("n_toxic", "n_clean", "n_all")]
        in_toxic = labelled.where("toxic = 1").mapInArrow(tk.released(_count(None)), counts).groupBy("word").agg(*sums).where(F.col("n_toxic") >= MIN_DOCS)
        bits = _bit_table(spark, steps.store(in_toxic.select("word")))
        every = labelled.unionByName(rest.withColumn("toxic", F.lit(None).cast("int"))).mapInArrow(tk.released(_count(bits)), counts).groupBy("word").agg(*sums).where(F.col("n_toxic") >= MIN_DOCS)
        # log-odds of a document holding the word, with the prior from all documents
        total = texts.count()
        lexicon = tk.shared_checkpoint(spark, scored_words(every, total, n_toxic, n_clean).where((F.col("z") >= MIN_Z) & (F.col("score") >= MIN_ODDS)).select("word", "score", "n_toxic", "n_clean"))
        # sums by scores to two places: a few thousand rows at most
        chances = lexicon.groupBy(F.round("score", 2).alias("score")).agg(F.sum((F.col("n_clean") + 0.5) / (n_clean * 100.0)).alias("chance"), F.sum("n_toxic").alias("n_toxic")).collect()
        scores, chance = (np.array([r[c] for r in chances], float) for c in ("score", "chance"))
        rate = sum(r.n_toxic for r in chances) / n_toxic / 100  # lexicon words to the hundred words of a toxic text
        penalty = float(np.clip(rate, 0.02, 0.5)) if chances else 1.0
        model = Model(lexicon, penalty, extreme_value_rate(scores, chance, penalty))
        bins = _measured(spark, labelled.where("toxic IS NOT NULL"), model, ["toxic"]).groupBy(F.round(F.col("x") / BIN).alias("bin")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()  # a row for each quarter of a natural logarithm
        x, t, n = (np.array(v, float) for v in zip(*[(r.bin * BIN, r.t, r.n) for r in bins], strict=True))
        model.slope, model.offset = _logistic(x, t, n - t)
        return model


def scored_words(counted: DataFrame, total: int, n_toxic: int, n_clean: int) -> DataFrame:
    """counted (word, n_toxic, n_clean, n_all: documents that hold the word) with score (log-odds) and z (its significance)."""
    alpha = F.lit(PRIOR_FLOOR) + F.lit(PRIOR_MASS) * F.col("n_all") / F.lit(float(total) * 100)
    odds = lambda n, size: F.log((F.col(n) + alpha) / (F.lit(float(size)) + 2 * alpha - F.col(n)))
    scored = counted.withColumn("score", odds("n_toxic", n_toxic) - odds("n_clean", n_clean))
    return scored.withColumn("z", F.col("score") / F.sqrt(1 / (F.col("n_toxic") + alpha) + 1 / (F.col("n_clean") + alpha)))


def extreme_value_rate(scores: np.ndarray, chance: np.ndarray, penalty: float) -> float:
    """Lambda: where the mean of exp(lambda * score) over the words of a clean text is one."""

    def excess(lam: float) -> float:
        return float((chance * np.exp(lam * scores)).sum() + (1 - chance.sum()) * np.exp(-lam * penalty) - 1)

    lo, hi = 1e-3, 2.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def passages(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key, score, passages: [from, to) words and score of every significant toxic one."""
    texts = tk.keyed_texts(docs)
    if model.lexicon is None:
        return texts.select("doc_id", "text_key", F.lit(float(model.score(np.zeros(1))[0])).alias("score"), F.array().cast(_PASSAGES).alias("passages"))
    logit = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("x") * model.slope + model.offset))
    return _measured(spark, texts, model, ["doc_id", "text_key"]).select("doc_id", "text_key", (1 / (1 + F.exp(-logit))).alias("score"), "passages")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = learn(spark, docs, tk.table(spark, sf_dir, "labels"), fold != 0)
    found = passages(spark, docs, model)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
