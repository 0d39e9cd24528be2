"""A corpus pipeline of five of the operators.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir)
and returns the documents that it keeps, with the columns of docs, but for the
last one, which returns their tokens. run() applies them to the documents table,
each stage's result being written to the shared folder before the next reads it.

Every stage: columns of any other name pass through, whatever they are called; an
empty table gives an empty one; texts of any length are handled whole. Null and
empty texts go in the first stage; where a later one is given them, they stay but
for a repeat of the same row in near_dedup, and have no tokens in bpe. A null
doc_id is an id of its own and comes first (last where the least id of a group stays).
Repeated rows lose the same lines, and one of them stays in near_dedup. Ties: of
equal runs of lines the first by (doc_id, a hash of the text) stays, of a group the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, langid, linededup, neardup
from graphloom.llm import textkit as tk


#: Entries of a worker's tables of words: the stages before have filled the executors' memory.
TABLE_WORDS = 40_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or in one that scores under langid.MIN_SCORE, go."""
    return langid.drop_unknown(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of fifty words or more go out of the texts; a text of which nothing is left goes; n_chars follows."""
    left = linededup.drop_copies(spark, docs)
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return neardup.keep_one(spark, docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate.drop_contaminated(spark, docs, tk.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, input_ids."""
    return bpe.tokenize(docs, words=TABLE_WORDS)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: Learned weights and a tokenizer's tables are out of SQL's reach; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table(spark, sf_dir, "documents")
    with tk.Steps(spark) as steps:
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            done, docs = docs, steps.keep(out) if name == STAGES[-2][0] else steps.store(out)
            steps.drop(done)
    return STAGES[-1][1](spark, docs, sf_dir)
