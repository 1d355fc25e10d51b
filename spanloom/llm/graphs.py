"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node with an edge in ``edges`` (columns ``a``, ``b``); the root is the least node.

    Each round hangs the neighbours of a node on their least neighbour; rounds grow with the logarithm of the longest path.
    Rounds are written to the shared folder, so a lost executor repeats one round at most. No node's edges meet in one task:
    minima combine before the shuffle, and are stored before they are joined back, so that Spark splits skewed joins.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), "m").union(least.select("u", "m")).filter("u <> m")
        now = materialize(small.select("u", F.col("m").alias("v")).distinct())
