"""Joins that hold where one key has a large share of the rows, and broadcasts of counted size."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes (as row_bytes counts them) that are broadcast; more is joined by shuffle.
BROADCAST_BYTES = 1_000_000
#: A key is hot if it holds more than one in so many rows: there are fewer hot keys than this.
HOT_SHARE = 1_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where df has columns of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes in memory."""

    def size(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                return F.aggregate(F.coalesce(F.transform(c, lambda x: size(x, kind.elementType)), F.array()), F.lit(24).cast("long"), lambda a, x: a + x)
            return F.greatest(F.size(c), F.lit(0)).cast("long") * 8 + 24
        if isinstance(kind, T.StructType):
            return fold(Column.__add__, [size(c.getField(f.name), f.dataType) for f in kind.fields], F.lit(16).cast("long"))
        return F.lit(8).cast("long")

    return fold(Column.__add__, [size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16).cast("long"))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (best a stored table: it is read for this) with a broadcast hint if its rows have limit bytes at most, counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit else df


def merged(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and merge: of tables that grow with the input, joined the same way at every size."""
    return df.hint("merge")


def skew_join(many: DataFrame, one: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined (inner or left) on keys with one; counts (keys, n; a stored table) says how many rows of many have each.

    Hot keys, those of more than one in HOT_SHARE rows, are dealt out by a salt,
    and the rows of `one` of each are repeated for its salts. With a row for each
    key that is 2 * HOT_SHARE rows at most; with several, that many times as many. It
    is the same at every size.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // HOT_SHARE)
    deal, salt = fresh(many.join(one.limit(0), keys), "hot_deal", "hot_salt")
    hot = F.broadcast(counts.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias(deal)))  # fewer than HOT_SHARE rows
    rest = [c for c in many.columns if c not in keys]
    others = F.xxhash64(*rest) if rest else F.spark_partition_id()  # rows that are nothing but their key differ by where they lie only
    unkeyed = fold(Column.__or__, [F.col(k).isNull() for k in keys])  # these match nothing, and are dealt out too
    dealt = many.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(others, deal), F.when(unkeyed, F.pmod(others, F.lit(HOT_SHARE))), F.lit(0)).cast("int"))
    copies = one.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(deal), F.lit(1)) - 1)))
    return dealt.drop(deal).join(merged(copies.drop(deal)), [*keys, salt], how).drop(salt)
