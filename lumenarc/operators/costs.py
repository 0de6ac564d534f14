"""What calls of priced models cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def token_costs(calls: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """calls (model, input_tokens, output_tokens, ...) with cost_usd.

    prices are dollars a million tokens, in and out, by model. A model that isn't listed has the price of the longest
    listed name that begins its own, else the default. Null counts are 0; a null model has the default price.
    """
    price = lambda p: F.struct(F.lit(float(p[0])).alias("i"), F.lit(float(p[1])).alias("o"))
    at: Column = price(default)
    for name in sorted(prices, key=len):
        at = F.when(F.startswith("model", F.lit(name)), price(prices[name])).otherwise(at)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return calls.withColumn("cost_usd", (n("input_tokens") * at["i"] + n("output_tokens") * at["o"]) / 1e6)


def estimate(rows: DataFrame, unit_cost: float) -> DataFrame:
    """(n, cost_usd) of treating each row once."""
    return rows.agg(F.count("*").alias("n")).withColumn("cost_usd", F.col("n") * F.lit(unit_cost))
