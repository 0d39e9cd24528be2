"""Binding vectors over dictionary ids as bit tables.

A vector is a DataFrame (word, bits): 64 ids a row, rows without members left
out. Matrices are encoded layers (u, v) of ids. A test of membership is an
equi-join on the word and a shift, so a vector of counted size is broadcast and the layer's
rows are neither shuffled nor made distinct to be masked: a vector of 100
million ids has 1.6 million rows at most, half a million ids fit a broadcast. Union and
intersection work on words, a reduction is one bitwise aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import merged, small

#: Bytes of a vector (as small() counts them, 32 a word) that is broadcast.
BROADCAST = 8_000_000


def of_ids(df: DataFrame, column: str) -> DataFrame:
    """The vector of a column of ids."""
    return df.where(F.col(column).isNotNull()).select(F.shiftright(column, 6).alias("word"), _bit(F.col(column)).alias("bits")).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))


def _bit(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))


def ids(vector: DataFrame, name: str = "v") -> DataFrame:
    """The members, a row each."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    return vector.select("word", F.explode(numbers).alias("__at")).select((F.col("word") * 64 + F.col("__at")).cast("long").alias(name))


def size(vector: DataFrame) -> DataFrame:
    """n: how many members."""
    return vector.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n"))


def masked(m: DataFrame, column: str, vector: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """Rows of m whose column is a member; vector is best a stored table."""
    named = vector.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    near = small(named, limit)
    held = m.withColumn("__word", F.shiftright(column, 6)).join(near if near is not named else merged(named), "__word")
    return held.where(F.col("__bits").bitwiseAND(_bit(F.col(column))) != 0).select(*m.columns)


def mxv(m: DataFrame, vector: DataFrame) -> DataFrame:
    """Rows with a cell in the vector's columns."""
    return of_ids(masked(m, "v", vector), "u")


def mxv_trans(m: DataFrame, vector: DataFrame) -> DataFrame:
    """Columns with a cell in the vector's rows."""
    return of_ids(masked(m, "u", vector), "v")


def vandv(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of both."""
    both = a.select("word", F.col("bits").alias("x")).join(b.select("word", F.col("bits").alias("y")), "word")
    return both.select("word", F.col("x").bitwiseAND(F.col("y")).alias("bits")).where("bits <> 0")


def vorv(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of either."""
    return a.unionByName(b).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))


def binding_matrix(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells with row and column in the given vectors."""
    return masked(masked(m, "u", rows), "v", cols)
