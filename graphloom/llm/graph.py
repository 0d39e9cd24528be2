"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of links (a, b); nodes are longs, nulls and loops are ignored.

    Only grouped minima and equi-joins that deal out hubs: no node's neighbours
    are ever gathered, in memory or in one task, so a hub may hold any share of
    the links. Each round is stored, and the one before deleted. The minima tell
    when it is over: no node has a lesser neighbour beside another one.
    """
    with tk.Steps(spark) as steps:
        edges = steps.store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = steps.store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
            if least.where("m < u AND n > 1").isEmpty():  # stars only: every node but the roots hangs on its root and has no other neighbour
                steps.hold(least)
                return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
            # larger neighbours hang on the least; an edge gives one at most, and what is given twice goes with the round's end
            large = tk.skew_join(both, least.select("u", "m"), least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            down = steps.store(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
            lowest = steps.store(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
            joined = tk.skew_join(down, lowest.select("u", "m"), lowest, ["u"])
            small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
            after = steps.store(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
            steps.drop(edges, least, down, lowest)
            edges = after
