"""Language identification (operator 9).

Sparse multinomial logistic regression on TF-IDF of character n-grams (one to
three characters, hashed to BUCKETS), trained with follow-the-regularised-leader
(proximal, L1 and L2 penalties), its confidence calibrated by a temperature.

Document frequencies cover all documents. The classifier is fitted on a bounded
sample of labelled rows: of each language, those whose id's hash lies in the
share that gives SAMPLE_PER_LANG rows on average (all, if it has no more); a
fifth of them sets the temperature. Training is one task over that sample's
sparse features: at the default, some 600 x 1,500 x 12 bytes (11 MB) and two
weights of 8 bytes for each of 32,768 buckets (0.5 MB) a language; 2.3 GB for 200
languages, which take a worker of that size or a smaller sample.

Nulls: a null text, or one without a letter, is "und" with score 0; rows without
doc_id or lang are not learned from. Without training rows every text is "und".
Ties between languages: the first by name. Repeated rows are kept. Whole texts.
An empty table gives an empty one. Other columns of docs, whatever their names,
are not looked at; the filtering stage passes them through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 1 << 15
GRAMS = 3
#: Rows of each language that the classifier is fitted on: all, or as many as this on average.
SAMPLE_PER_LANG = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: The least score with which the filtering stage keeps a document.
MIN_SCORE = 0.3
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text, ascending, and how often."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    h = chars + np.uint64(1)
    for n in range(1, GRAMS + 1):
        if len(chars) < n:
            break
        if n > 1:
            h = h[:-1] * np.uint64(0x1000193) + chars[n - 1 :] + np.uint64(1)
        counts += np.bincount(((h * _SPREAD) >> _SHIFT).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, weights, biases, temperature) from rows of (language, buckets, values)."""
    langs = sorted({lang for lang, _, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    held, taught = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    z, n = np.zeros((BUCKETS + 1, len(langs))), np.zeros((BUCKETS + 1, len(langs)))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrunk = np.where(np.abs(zs) > L1, zs - np.sign(zs) * L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(taught)):
            lang, at, x = taught[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            wrong = _softmax(x @ w)
            wrong[number[lang]] -= 1
            g = np.outer(x, wrong)
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = n_new
    w = weights(np.arange(BUCKETS + 1))
    logits = np.array([x @ w[at] + w[BUCKETS] for _, at, x in held])
    truth = np.array([number[lang] for lang, _, _ in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    return langs, w[:BUCKETS], w[BUCKETS], float(min(np.geomspace(0.5, 5, 60), key=loss))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many there are: BUCKETS + 1 rows reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for x in batch.column("text"):
                if x.is_valid:
                    seen[gram_counts(x.as_py())[0]] += 1
                    rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS)), pa.array(np.append(seen[at], rows))], names=["bucket", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tk.released(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in got:
        out[r.bucket] = r.n
    return out[:BUCKETS], int(out[BUCKETS])


def _predictor(spark: SparkSession, docs: DataFrame, learn: Column | None, sample_per_lang: int) -> Callable[[pa.Array], tuple[list[str], list[float]]]:
    """A function for the workers: languages and scores of texts. learn: which rows of docs are training rows (all that have a lang, if None)."""
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    shared_idf = spark.sparkContext.broadcast(idf)
    rank = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 1)
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))
    sizes = docs.where(usable).groupBy(F.col("lang").cast("string").alias("lang")).count().collect()  # a row for each language
    last = {r.lang: int(2**63 * min(1.0, sample_per_lang / r["count"])) - 1 for r in sizes}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_idf.value
        for batch in batches:
            rows = []
            for lang, r, text in zip(batch.column("lang").to_pylist(), batch.column("rank").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, counts = gram_counts(text)
                rows.append((lang, r, at, tf_idf(counts, table[at])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())], strict=True)],
                names=["lang", "rank", "at", "x"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for lang, r, at, x in zip(batch.column("lang").to_pylist(), batch.column("rank").to_pylist(), batch.column("at"), batch.column("x"), strict=True):
                rows.append((r, lang, at.values.to_numpy(), x.values.to_numpy()))
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        langs, w, bias, t = fit([r[1:] for r in rows])
        for i, lang in enumerate(langs):
            at = np.flatnonzero(w[:, i])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w[at, i].tolist()], pa.list_(pa.float64())), pa.array([float(bias[i])]), pa.array([t])], names=["lang", "at", "w", "bias", "t"])

    if last:
        bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
        sample = docs.where(usable & (rank <= bound[F.col("lang").cast("string")])).select(F.col("lang").cast("string").alias("lang"), rank.alias("rank"), F.col("text").cast("string").alias("text"))
        taught = sample.mapInArrow(tk.released(features), "lang string, rank bigint, at array<int>, x array<double>").repartition(1).mapInArrow(tk.released(train), "lang string, at array<int>, w array<double>, bias double, t double")
        model = sorted(taught.collect(), key=lambda r: r.lang)  # a row for each language
    else:
        model = []
    weights = np.zeros((BUCKETS, len(model)))
    for i, r in enumerate(model):
        weights[r["at"], i] = r.w
    bias, t = np.array([r.bias for r in model]), model[0].t if model else 1.0
    langs = [r.lang for r in model]
    shared = spark.sparkContext.broadcast((weights * (idf[:, None] if model else 1), idf))

    def predict(texts: pa.Array) -> tuple[list[str], list[float]]:
        w, table = shared.value
        said, scores = [], []
        for x in texts:
            text = x.as_py()
            if not langs or text is None or not _LETTER.search(text):
                said.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, counts = gram_counts(text)
            tf = 1 + np.log(counts)
            p = _softmax((tf @ w[at] / np.sqrt(((tf * table[at]) ** 2).sum()) + bias) / t)
            best = int(p.argmax())
            said.append(langs[best])
            scores.append(float(p[best]))
        return said, scores

    predict.langs = langs
    return predict


def identify(spark: SparkSession, docs: DataFrame, learn: Column | None = None, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """doc_id, text_key, lang_pred, score. learn: which rows of docs are training rows (all that have a lang, by default)."""
    predict = _predictor(spark, docs, learn, sample_per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "text_key", "lang_pred", "score"])

    return tk.keyed_texts(docs).mapInArrow(tk.released(run), "doc_id bigint, text_key bigint, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = tk.table(spark, sf_dir, "documents")
    return identify(spark, docs, fold != 2).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unknown(spark: SparkSession, docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows of no language, and those whose language scores under min_score; all columns stay. Rows are judged as they pass: nothing is joined.

    Where no row tells of a language, none is learned and only texts without a letter go.
    """
    predict = _predictor(spark, docs, None, SAMPLE_PER_LANG)
    at = docs.columns.index("text")
    taught = bool(predict.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = predict(batch.column(at).cast(pa.string()))
            keep = [lang != UNKNOWN and score >= min_score for lang, score in zip(said, scores, strict=True)] if taught else [x.is_valid and bool(_LETTER.search(x.as_py())) for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tk.released(run), docs.schema)
