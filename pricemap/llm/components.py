"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemap.llm.store import drop, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (src, dst); root is the smallest node that it reaches.

    Each round joins every node's neighbours to their smallest one; rounds grow with the logarithm of
    the longest path.  A table per round is written, so lost executors cost no earlier round.  A hub
    is one side of an equi-join against one row, which adaptive execution splits.
    """
    current = saved(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "stars")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, current = current, saved(small, "stars")
        drop(before)
        drop(large)
        now = _state(current)
        if now == state:
            break
        state = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
