"""Chat formatting with cumulative-snapshot collapse (operator 10) [native].

A log often holds a conversation many times, once after every turn. Each turn
gets a rolling hash of its conversation up to it; a conversation whose last hash
is the hash of an inner turn of another one is a snapshot of that longer one and
goes (anti-join on distinct prefix hashes). Of conversations that are the same
throughout, the one with the smallest id stays. What stays is rendered.

The rolling hash is a running xor of two 64-bit hashes of (place, role, text),
so equal hashes with equal length mean equal turns up to chance of 2**-128.

Nulls: rows without conv_id go; a null role is "unknown", a null text empty, a
null turn comes first. Ties: turns of one number are put in order by role and
text; identical rows count once. Texts of any length are kept whole. An empty
table gives an empty one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of distinct rows in order; rows that come partitioned by conv_id aren't shuffled."""
    return rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: distinct rows in order. Texts are shuffled once."""
    return _ordered(_turns(turns).repartition("conv_id"))


def maximal(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, and n_collapsed: the identical conversations that it stands for, itself left out. A stored table."""
    running = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy("place")
    hashed = ordered_turns(turns).select("conv_id", "place", F.xxhash64(F.lit(1), "place", "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text", "place").alias("b"))
    rolled = hashed.select(
        "conv_id", "place", F.expr("bit_xor(a)").over(running).alias("a"), F.expr("bit_xor(b)").over(running).alias("b"), F.lead("place").over(after).isNull().alias("last")
    )
    with tk.Steps(spark) as steps:
        rolled = steps.store(rolled)
        whole = rolled.where("last").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), (F.count("*") - 1).alias("n_collapsed"))
        inner = rolled.where("NOT last").select("place", "a", "b").distinct()
        return steps.keep(whole.join(tk.merged(inner), ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_collapsed"))


def render(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_collapsed, chat: the conversations that no other one continues, as chat text."""
    mine = _turns(turns).join(tk.merged(maximal(spark, turns)), "conv_id")
    lines = _ordered(mine).select(
        "conv_id", "n_turns", "n_collapsed", "place", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n")).alias("line")
    )
    grouped = lines.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("n_collapsed").alias("n_collapsed"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return grouped.select("conv_id", "n_turns", "n_collapsed", F.array_join(F.col("lines.line"), "").alias("chat"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, tk.table(spark, sf_dir, "conversations"))


OP10_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
g AS (SELECT l, min(conv_id) AS conv_id, count(*) - 1 AS n_collapsed FROM c GROUP BY l)
SELECT conv_id, len(l)::BIGINT AS n_turns, n_collapsed::BIGINT AS n_collapsed, array_to_string(l, '') AS chat FROM g WHERE l NOT IN (SELECT l FROM p)
"""
