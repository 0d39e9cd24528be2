"""Dense numbers over a distributed sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import delete, stored


def numbered(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """df with a column that counts its rows, in order of keys (which are unique), from start.

    The rows are sorted by ranges, and each is numbered in its range as it is
    written; only the ranges' row counts reach the driver, so no task sees more
    than its range. The written table is what later plans read: a lost executor
    can't lead to other ranges.
    """
    at = f"__{name}_at"
    source, path = stored(df.sparkSession, df)  # the sort looks at its rows twice
    ordered, _ = stored(df.sparkSession, source.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    delete(df.sparkSession, path)
    part, row = F.shiftright(at, 33), F.col(at).bitwiseAND(2**33 - 1)
    counts = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], start
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    starts = df.sparkSession.createDataFrame(before, "__part bigint, __before bigint")  # a row for each range
    placed = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, (F.col("__before") + row).cast("long")).drop(at, "__part", "__before")
