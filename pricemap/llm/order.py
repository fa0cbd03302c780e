"""Ranks within groups of any size: a group is spread over as many sorted ranges as its rows need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.store import saved

#: ``monotonically_increasing_id`` is the partition above these bits, and the row in it below.
ROW_BITS = 33


def numbered(df: DataFrame, group: str, by: list) -> DataFrame:
    """``df`` in ranges of (group, *by), written: __part and __pos tell a row's range and its place there."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(group, *by).sortWithinPartitions(group, *by).withColumn("__at", place)
    table = saved(ranged, "ranges")
    return table.withColumns({"__part": F.shiftright("__at", ROW_BITS), "__pos": F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("__at")


def ranked(df: DataFrame, group: str, by: list) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``by`` within ``group``) and ``size`` of the group; rows that tie have any order.

    A range counts its rows of a group; the counts of a group's earlier ranges, at most one row a range,
    are added up by a window.
    """
    table = numbered(df, group, by)
    ranges = table.groupBy("__part", group).agg(F.count("*").alias("n"), F.min("__pos").alias("first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = ranges.select("__part", group, (before - F.col("first")).alias("__offset"), F.sum("n").over(own).alias("size"))
    joined = table.join(offset.hint("merge"), ["__part", group])
    return joined.withColumn("rank", F.col("__pos") + F.col("__offset")).drop("__part", "__pos", "__offset")
