"""Cost of outside model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a price list that is broadcast.
PRICE_ROWS = 10_000


def usage_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call's cost: as reported, else tokens at the model's price per million, else 0; and whether it is an estimate (A10).

    ``prices`` (model, input_price, output_price) is broadcast while it is a short list.
    """
    short = len(prices.limit(PRICE_ROWS + 1).collect()) <= PRICE_ROWS
    joined = events.join(prices.hint("broadcast" if short else "merge"), "model", "left")
    estimate = F.col("prompt_tokens") / 1e6 * F.col("input_price") + F.col("completion_tokens") / 1e6 * F.col("output_price")
    return joined.withColumns({"cost": F.round(F.coalesce("reported_cost", estimate, F.lit(0.0)), 8), "estimated": F.col("reported_cost").isNull()}).drop("input_price", "output_price")


def accumulate_usage(events: DataFrame) -> DataFrame:
    """Totals per process over the event table, so a replay changes nothing."""
    return events.groupBy("process_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.round(F.sum(F.coalesce("reported_cost", F.lit(0.0))), 4).alias("cost"), F.count("*").alias("runs"),
    )
