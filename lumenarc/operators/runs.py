"""Runs, calls, failures and archives: the tables that a pipeline keeps about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W


def run_metrics(runs: DataFrame) -> DataFrame:
    """runs with success_rate, error_rate, cost_per_conversation and total_tokens; nothing over nothing is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    done, failed = F.col("processed"), F.col("failed")
    return runs.withColumns({"success_rate": share(done, done + failed), "error_rate": share(F.col("failed_calls"), F.col("calls")), "cost_per_conversation": share(F.col("cost"), done), "total_tokens": F.col("input_tokens") + F.col("output_tokens")})


def provider_stats(calls: DataFrame, by: str, cost: Column, failed: Column, latency: Column | None = None) -> DataFrame:
    """(provider, calls, cost, failures, success_rate, latency): a row a provider, and one of all with a null provider."""
    aggs = [F.count("*").alias("calls"), F.sum(cost).alias("cost"), F.count_if(failed).alias("failures"), (1 - F.count_if(failed) / F.count("*")).alias("success_rate")]
    aggs += [F.avg(latency).alias("latency")] if latency is not None else []
    return calls.rollup(F.col(by).alias("provider")).agg(*aggs)


def last(df: DataFrame, n: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """The first n rows in an order, of all or of each group."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def health(runs: DataFrame, ended: str, error_rate: str = "error_rate", limit: float = 0.1) -> DataFrame:
    """(status, bad): of the last five runs, three with too many errors are critical, one is degraded."""
    bad = last(runs, 5, F.desc(ended)).agg(F.count_if(F.col(error_rate) > limit).alias("bad"))
    return bad.select(F.when(F.col("bad") >= 3, "critical").when(F.col("bad") >= 1, "degraded").otherwise("healthy").alias("status"), "bad")


def usage(calls: DataFrame, tokens: Column, cost: Column, ok: Column) -> DataFrame:
    """(calls, tokens, cost, success_rate in percent)."""
    return calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.coalesce(100 * F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("success_rate"))


def dashboard(runs: DataFrame, ended: str) -> DataFrame:
    """(total_runs, total_conversations, total_calls, total_tokens, total_cost, mean_success_rate, mean_cost) over runs of run_metrics()."""
    return runs.agg(F.count("*").alias("total_runs"), F.sum("processed").alias("total_conversations"), F.sum("calls").alias("total_calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("total_cost"), F.avg("success_rate").alias("mean_success_rate"), F.avg("cost").alias("mean_cost"), F.max(ended).alias("last_run"))


def smoothed(batches: DataFrame, order: str, value: str, by: list[str], keep: float = 0.7) -> DataFrame:
    """(by, mean): the exponentially weighted mean of batches in their order. A row a batch, so a key's list is short."""
    lists = batches.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("x"))
    rest = F.slice("x", F.lit(2), F.size("x"))
    return lists.select(*by, F.aggregate(rest, F.element_at("x", 1)["v"], lambda s, x: keep * s + (1 - keep) * x["v"]).alias("mean"))


def processing(batch: DataFrame, kind: str) -> DataFrame:
    """(found, new, duplicate, processed, failed, rate): a row's kind says what became of it."""
    n = lambda *names: F.count_if(F.col(kind).isin(*names))
    return batch.agg(F.count("*").alias("found"), n("processed", "failed").alias("new"), n("duplicate").alias("duplicate"), n("processed").alias("processed"), n("failed").alias("failed"), F.coalesce(F.try_divide(n("processed"), n("processed", "failed")), F.lit(0.0)).alias("rate"))


def attempts(failures: DataFrame, key: list[str], ts: str, error: str) -> DataFrame:
    """(key, attempts, last_error, last_at): how often each item failed, and how the last time."""
    return failures.groupBy(*key).agg(F.count("*").alias("attempts"), F.max_by(error, F.struct(ts, error)).alias("last_error"), F.max(ts).alias("last_at"))


def cleared(failures: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The failures of items that are not done."""
    return failures.join(done.select(*key).distinct(), key, "left_anti")


def state_stats(processed: DataFrame, failures: DataFrame, source: str) -> DataFrame:
    """(source, processed, failed): a row a source, and one of all with a null source."""
    both = processed.select(F.col(source), F.lit(1).alias("p"), F.lit(0).alias("f")).unionByName(failures.select(F.col(source), F.lit(0).alias("p"), F.lit(1).alias("f")))
    return both.rollup(source).agg(F.sum("p").alias("processed"), F.sum("f").alias("failed"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, modified) of the files under a folder, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def changes(registered: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): unchanged, new_content (longer), replaced (shorter), modified (as long, but other), missing or new."""
    old = registered.select("path", F.col("bytes").alias("was"), F.col("sha256").alias("old_sha"))
    both = old.join(now.select("path", "bytes", "sha256"), "path", "full_outer")
    kind = F.when(F.col("bytes").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("sha256") == F.col("old_sha"), "unchanged")
    return both.select("path", kind.when(F.col("bytes") > F.col("was"), "new_content").when(F.col("bytes") < F.col("was"), "replaced").otherwise("modified").alias("change"))


def archive_status(archives: DataFrame) -> DataFrame:
    """(archives, processed, pending, due): sums, and the names of the archives with something to do."""
    pending = F.greatest(F.col("total") - F.col("processed"), F.lit(0))
    return archives.agg(F.count("*").alias("archives"), F.sum("processed").alias("processed"), F.sum(pending).alias("pending"), F.array_sort(F.collect_list(F.when(pending > 0, F.col("name")))).alias("due"))


def cursor(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """(by, cursor, n): how far each archive has been read, by the latest time and not by the last row."""
    return rows.groupBy(*by).agg(F.max(ts).alias("cursor"), F.count("*").alias("n"))


def advanced(state: DataFrame, batch: DataFrame, by: list[str]) -> DataFrame:
    """The state after a batch (both by, cursor, n): cursors never go back, counts add up."""
    return state.unionByName(batch).groupBy(*by).agg(F.max("cursor").alias("cursor"), F.sum("n").alias("n"))


def kept_since(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    """Rows not older than so many days; rows without a time are kept."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))))


def recent(df: DataFrame, ts: str, days: int, as_of: Column, limit: int, where: Column | None = None, id_col: str | None = None) -> DataFrame:
    """Events of the last days, the newest first."""
    rows = df.filter(F.col(ts) > as_of - F.make_dt_interval(F.lit(days)))
    rows = rows if where is None else rows.filter(where)
    return rows.orderBy(F.desc(ts), *([id_col] if id_col else [])).limit(limit)


def retained(backups: DataFrame, keep: int, made: str = "made", by: list[str] | None = None) -> DataFrame:
    """The newest backups, of all or of each group."""
    return last(backups, keep, F.desc(made), by=by)


def damaged(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files of a manifest (path, sha256) that are missing or whose hash is another."""
    got = found.select("path", F.col("sha256").alias("is"))
    rows = listed.select("path", "sha256").join(got, "path", "left")
    return rows.filter(~F.col("is").eqNullSafe(F.col("sha256"))).select("path", F.when(F.col("is").isNull(), "missing").otherwise("altered").alias("problem"))
