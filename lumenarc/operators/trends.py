"""Series over calendar periods: growth of halves, zero-filled grids, anomalies, slopes, latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def growth(series: DataFrame, by: list[str], period: str = "period", n: str = "n") -> DataFrame:
    """(by, periods, early, late, growth, direction): mean of the later half over the earlier, in percent."""
    w = W.partitionBy(*by)
    rows = series.withColumn("_i", F.row_number().over(w.orderBy(period)) - 1).withColumn("_all", F.count("*").over(w))
    mid = F.floor(F.col("_all") / 2)
    out = rows.groupBy(*by).agg(
        F.max("_all").alias("periods"),
        (F.coalesce(F.sum(F.when(F.col("_i") < mid, F.col(n))), F.lit(0)) / F.greatest(F.max(mid), F.lit(1))).alias("early"),
        (F.coalesce(F.sum(F.when(F.col("_i") >= mid, F.col(n))), F.lit(0)) / F.greatest(F.max(F.col("_all") - mid), F.lit(1))).alias("late"),
    )
    change = F.when(F.col("periods") < 2, 0.0).when(F.col("early") > 0, (F.col("late") - F.col("early")) / F.col("early") * 100).when(F.col("late") > 0, 100.0).otherwise(0.0)
    out = out.withColumn("growth", change)
    return out.withColumn("direction", F.when(F.col("growth") > 10, "rising").when(F.col("growth") < -10, "declining").otherwise("stable"))


def zero_filled(df: DataFrame, period: str, key: str, limit: int = 20) -> DataFrame:
    """(key, period, n) of the keys with the most rows, with 0 where a period has none."""
    keys = df.groupBy(key).agg(F.count("*").alias("_t")).orderBy(F.desc("_t"), key).limit(limit).select(key)
    grid = df.select(period).distinct().join(F.broadcast(keys))
    return grid.join(df.groupBy(period, key).agg(F.count("*").alias("n")), [period, key], "left").select(key, period, F.coalesce("n", F.lit(0)).alias("n"))


def sigma_outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("total"))
    return df.join(F.broadcast(stats)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("total").alias("total"), F.count_if(F.col(value) < F.col("mean") - sigmas * F.col("std")).alias("low"))


def indexed_percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, int]]) -> DataFrame:
    """(by, n, mean, largest, a column a wanted percentile): the value at int(n * p) of a group's sorted values.

    A percentile with a least number of values takes the largest where there are no more than that. Values are counted first, so
    a group is as large as its distinct values are many, and nothing is gathered in one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    rows = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(W.partitionBy(*by))})
    at = lambda p: F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    holds = lambda p: (F.col("_upto") > at(p)) & (F.col("_upto") - F.col("_n") <= at(p))
    pick = lambda p, least: F.coalesce(F.max(F.when(holds(p) & (F.col("_all") > least), F.col("_v"))), F.max("_v"))
    mean = F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")
    return rows.groupBy(*by).agg(F.sum("_n").alias("n"), mean.alias("mean"), F.max("_v").alias("largest"), *[pick(p, least).alias(n) for n, (p, least) in wanted.items()])


def slope(df: DataFrame, order: str, value: str, by: list[str], flat: float = 0.01) -> DataFrame:
    rows = df.withColumn("_x", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), F.col("_x")).alias("slope"))
    return out.withColumn("trend", F.when(F.col("n") < 3, "stable").when(F.col("slope") > flat, "improving").when(F.col("slope") < -flat, "declining").otherwise("stable"))
