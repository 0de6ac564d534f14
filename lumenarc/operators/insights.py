"""Statistics of a repository and what stands out in them; each insight is a row of one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from . import trends

#: Columns of an insight: data is JSON.
SCHEMA = "id string, category string, title string, description string, score double, data string"


def top_counts(df: DataFrame, col: str, k: int = 10, keep_null: bool = True) -> DataFrame:
    """(value, n): the commonest values; null and empty ones are a value too, or none."""
    rows = df if keep_null else df.filter(F.col(col).isNotNull() & (F.col(col).cast("string") != ""))
    return rows.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def overview(df: DataFrame, code: Column, errors: Column, score: Column) -> DataFrame:
    """(total, with_code, with_errors, average_score, code_rate, error_rate) in one pass."""
    n = F.count("*")
    return df.agg(
        n.alias("total"), F.count_if(code).alias("with_code"), F.count_if(errors).alias("with_errors"), F.round(F.avg(score), 1).alias("average_score"),
        F.try_divide(F.count_if(code), n).alias("code_rate"), F.try_divide(F.count_if(errors), n).alias("error_rate"),
    )


def dominant(df: DataFrame, col: str) -> DataFrame:
    """(value, share): the commonest value and its share of all rows, if there are several values."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"), F.sum("n").alias("all"), F.count("*").alias("values")).filter("values > 1").select("value", (F.col("n") / F.col("all")).alias("share"))


def monthly(df: DataFrame, ts: str) -> DataFrame:
    return df.filter(F.col(ts).isNotNull()).groupBy(F.date_trunc("month", ts).alias("period")).agg(F.count("*").alias("n"))


def activity(df: DataFrame, ts: str, least: float = 20.0) -> DataFrame:
    """(periods, early, late, growth, direction) of rows a month, if they changed by more than `least` percent."""
    found = trends.growth(monthly(df, ts), [])
    found = found.filter((F.col("periods") >= 2) & (F.abs("growth") > least))
    return found.withColumn("direction", F.when(F.col("growth") > 0, "increasing").otherwise("decreasing"))


def peak_day(df: DataFrame, ts: str, times: float = 3.0) -> DataFrame:
    """(day, n, mean): the busiest day, if it has more than so many times the mean of the days that have rows."""
    days = df.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    top = days.agg(F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("day"), F.max("n").alias("n"), F.avg("n").alias("mean"))
    return top.filter(F.col("n") > times * F.col("mean"))


def running(df: DataFrame, period: str, n: str = "n") -> DataFrame:
    """df with total: the sum up to and with each period. A row a period, so few."""
    return df.withColumn("total", F.sum(n).over(W.orderBy(period).rowsBetween(W.unboundedPreceding, 0)))


def _row(df: DataFrame, id_: Column, category: str, title: Column, description: Column, score: Column, data: Column) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(category).alias("category"), title.alias("title"), description.alias("description"), score.cast("double").alias("score"), F.to_json(data).alias("data"))


def _top(df: DataFrame, value: Column, id_: str, title: str, lead: str, score: float) -> DataFrame:
    found = top_counts(df.select(value.alias("v")), "v", 5, keep_null=False)
    one = found.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("value").alias("name")))).alias("x")).filter(F.size("x") > 0)
    names = F.array_join(F.slice(F.transform("x", lambda v: v["name"]), 1, 3), ", ")
    data = F.struct(F.transform("x", lambda v: F.struct(v["name"].alias("name"), (-v["m"]).alias("count"))).alias("items"))
    return _row(one, F.lit(id_), "summary", F.lit(title), F.concat(F.lit(lead), names), F.lit(score), data)


def insights(df: DataFrame, ts: str, source: str, code: Column, errors: Column, score: Column, languages: Column, domain: Column, rising: DataFrame | None = None) -> DataFrame:
    """All insights, the best first: overview, top lists, rising and falling technologies, rates, dominance, outliers, peaks.

    rising has rows of trends.growth() with a column name, those with the most rows first (n).
    """
    whole = overview(df, code, errors, score)
    pct = lambda c: F.format_string("%.0f%%", 100 * c)
    out = [_row(whole.filter("total > 0"), F.lit("summary_overview"), "summary", F.lit("Repository Overview"), F.format_string("%d conversations, %d with code (%.0f%%)", "total", "with_code", 100 * F.col("code_rate")), F.lit(1.0), F.struct("total", "with_code", "with_errors", "average_score"))]
    out.append(_top(df.select(F.explode(languages).alias("l")), F.col("l"), "top_technologies", "Top Technologies", "Most used: ", 0.9))
    out.append(_top(df.select(domain.alias("d")), F.col("d"), "top_domains", "Top Domains", "Focus areas: ", 0.85))
    if rising is not None:
        five = rising.orderBy(F.desc("n"), "name").limit(5)
        up, down = five.filter("growth > 50"), five.filter("growth < -30")
        out.append(_row(up, F.concat(F.lit("trend_"), "name"), "trend", F.concat(F.initcap("name"), F.lit(" is Rising")), F.concat(pct(F.col("growth") / 100), F.lit(" increase in recent period")), F.least(F.lit(0.9), 0.5 + F.col("growth") / 200), F.struct("name", "growth")))
        out.append(_row(down, F.concat(F.lit("decline_"), "name"), "trend", F.concat(F.initcap("name"), F.lit(" Usage Declining")), F.concat(pct(-F.col("growth") / 100), F.lit(" decrease in recent period")), F.lit(0.6), F.struct("name", "growth")))
    moved = activity(df, ts)
    out.append(_row(moved, F.lit("activity_trend"), "trend", F.concat(F.lit("Activity is "), F.initcap("direction")), F.concat(pct(F.abs("growth") / 100), F.lit(" change in activity level")), F.lit(0.75), F.struct("growth", "early", "late")))
    out.append(_row(whole.filter("error_rate > 0.3"), F.lit("high_debug_rate"), "pattern", F.lit("High Debug Activity"), F.concat(pct(F.col("error_rate")), F.lit(" of conversations involve debugging")), F.lit(0.7), F.struct("error_rate")))
    out.append(_row(whole.filter("code_rate > 0.7"), F.lit("code_heavy"), "pattern", F.lit("Code-Heavy Repository"), F.concat(pct(F.col("code_rate")), F.lit(" of conversations contain code")), F.lit(0.65), F.struct("code_rate")))
    lead = dominant(df, source).filter("share > 0.8")
    out.append(_row(lead, F.lit("source_dominance"), "pattern", F.concat(F.initcap("value"), F.lit(" Dominant")), F.concat(pct(F.col("share")), F.lit(" of conversations from "), F.col("value")), F.lit(0.5), F.struct("value", "share")))
    low = trends.sigma_outliers(df.select(score.alias("s")), "s").filter("total >= 10 and low > 0")
    out.append(_row(low, F.lit("quality_outliers"), "anomaly", F.lit("Quality Outliers Detected"), F.format_string("%d conversations with unusually low quality scores", "low"), F.lit(0.6), F.struct("low", (F.col("mean") - 2 * F.col("std")).alias("threshold"))))
    peak = peak_day(df, ts).join(F.broadcast(whole.select("total"))).filter("total >= 10")
    out.append(_row(peak, F.lit("activity_spike"), "anomaly", F.lit("Activity Spike Detected"), F.format_string("Unusual activity on %s: %d conversations", F.col("day").cast("string"), F.col("n")), F.lit(0.55), F.struct("day", "n", "mean")))
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("score"), "id")


def feature_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(total, one count a flag): run statistics of the model-free features, or verification counts, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): how many rows each table has."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in tables.items()])


def segment_stats(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conversations, multi_topic, share, mean): how many conversations have several segments."""
    per = segments.groupBy(conv).agg(F.count("*").alias("k"))
    return per.agg(F.count("*").alias("conversations"), F.count_if(F.col("k") > 1).alias("multi_topic"), F.try_divide(F.count_if(F.col("k") > 1), F.count("*")).alias("share"), F.avg("k").alias("mean"))


def top_by_group(df: DataFrame, group: str, kind: str, name: str, limits: dict[str, int]) -> DataFrame:
    """(group, kind, name, n, r): the commonest names of each kind in each group; counted before they are ranked."""
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(kind)]
    counts = df.groupBy(group, kind, name).agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy(group, kind).orderBy(F.desc("n"), name))).filter(F.col("r") <= most)


def cluster_labels(clusters: DataFrame, things: DataFrame, cluster: str = "cluster", id_col: str = "convo_id", outliers=-1) -> DataFrame:
    """(cluster, label, keywords, technologies) from things (id, kind in tag, term, lang; name).

    A label is the top tag, else the top term, else the top language with `Development`, else a number.
    """
    tops = top_by_group(clusters.select(cluster, id_col).join(things, id_col), cluster, "kind", "name", {"tag": 3, "term": 5, "lang": 3})
    pick = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("r", "name")))), lambda x: x["name"])
    lists = tops.groupBy(cluster).agg(pick("tag").alias("tags"), pick("term").alias("keywords"), pick("lang").alias("technologies"))
    rows = clusters.select(cluster).distinct().join(lists, cluster, "left")
    first = lambda c: F.get(c, F.lit(0))
    label = F.coalesce(F.initcap(first("tags")), F.initcap(first("keywords")), F.concat(F.initcap(first("technologies")), F.lit(" Development")), F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    empty = F.array().cast("array<string>")
    return rows.select(cluster, F.when(F.col(cluster) == outliers, "Miscellaneous").otherwise(label).alias("label"), F.coalesce("keywords", empty).alias("keywords"), F.coalesce("technologies", empty).alias("technologies"))
