"""Joins to the latest earlier row of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str, else_latest: bool = False) -> DataFrame:
    """``left`` with ``name``: ``value`` of the latest row of ``right`` up to its own time, within equal ``by``.

    Both tables have ``by`` and a time ``at``.  With ``else_latest``, rows before all of ``right``'s times, or
    without one, take the latest of all.  Both go into one ordered window, in which the last value so far
    is carried on; no list is made.  Null times of ``right`` count for nothing.
    """
    columns = left.columns
    rows = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.struct(*columns).alias("__row"))
    marks = right.filter(F.col(at).isNotNull()).select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    # one row a time: the largest value on ties
    marks = marks.groupBy(*by, "__at", "__side").agg(F.max("__value").alias("__value"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    own = Window.partitionBy(*by)
    so_far = F.last("__value", ignorenulls=True).over(own.orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    latest = F.max_by("__value", F.when(F.col("__side") == 0, F.col("__at"))).over(own)
    found = F.coalesce(so_far, latest) if else_latest else so_far
    return both.withColumn("__found", found).filter("__side = 1").select("__row.*", F.col("__found").alias(name))
