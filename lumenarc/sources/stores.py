"""Tables and files that the engine keeps: conversations, vectors, metrics, samples."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import tables
from ..workspace import new_path


def repo_path(spark: SparkSession, candidates: list[str], setting: str = "spark.lumenarc.repository", variable: str = "LUMENARC_REPOSITORY") -> str:
    """Where the repository is: the session's setting, else the environment's, else the first candidate that Spark can list."""
    found = spark.conf.get(setting, None) or os.environ.get(variable)
    if found:
        return found
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in candidates:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(hadoop).exists(at):
            return path
    raise FileNotFoundError(f"no repository among {candidates}")


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def overwrite(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Replaces a table that df may have been read from: it is written beside it first."""
    spark = df.sparkSession
    beside = new_path(spark, "swap")
    df.write.format(fmt).save(beside)
    spark.read.schema(df.schema).format(fmt).load(beside).write.mode("overwrite").format(fmt).save(path)


def read_rows(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def bulk_import(old: DataFrame, new: DataFrame, key: list[str], newest: list[Column], text: str = "raw_text", most: int = 50_000) -> DataFrame:
    """old with the newest row of each key of new in place of its own; texts are cut as the table has them."""
    rows = tables.latest(new, key, *newest)
    rows = rows.withColumn(text, F.substring(text, 1, most)) if text in rows.columns else rows
    return tables.upsert(old, tables.conform(rows, old.columns), key)


def with_external_ids(df: DataFrame, id_col: str = "convo_id", other: str = "external_id") -> DataFrame:
    """df with the id of its own where the other is null; rows with neither are named after their content."""
    named = F.concat(F.lit("conv_"), F.substring(F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != other])), 256), 1, 16))
    return df.withColumn(other, F.coalesce(F.col(other), F.col(id_col).cast("string"), named))


def save_vectors(df: DataFrame, path: str, id_col: str, vec: str) -> None:
    df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, id_=None) -> DataFrame:
    """(id, vector), of one id if it is given: the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if id_ is None else rows.filter(F.col("id") == id_)


def file_stats(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """(files, bytes, rows) of a table's folder; the sizes come from the file listing, not from the content."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return sizes.join(spark.read.format(fmt).load(path).agg(F.count("*").alias("rows")))  # one row each


def count_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): lines that are not empty, or the length of a file's JSON array."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v")).filter("v <> ''")
    per = lines.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.startswith("v", F.lit("["))).alias("arrays"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.json_array_length("value").alias("items"))
    return per.join(whole, "path", "left").select("path", F.coalesce(F.when(F.col("arrays") > 0, F.col("items")), F.col("n")).cast("long").alias("n"))


RUNS = "total_cost double, total_tokens long, historical_runs array<struct<run_id:string,started_at:string,completed_at:string,conversations_processed:long,conversations_failed:long,total_api_calls:long,total_tokens:long,total_cost_usd:double>>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a metrics document, a row each; tokens are shared half and half between input and output."""
    r = spark.read.schema(RUNS).option("multiLine", True).json(path).select(F.explode("historical_runs").alias("r")).select("r.*")
    half = F.floor(F.coalesce("total_tokens", F.lit(0)) / 2)
    return r.select("run_id", T.when_said(F.col("started_at")).alias("started"), T.when_said(F.col("completed_at")).alias("ended"), F.col("conversations_processed").alias("processed"), F.col("conversations_failed").alias("failed"), F.col("total_api_calls").alias("calls"), half.alias("input_tokens"), half.alias("output_tokens"), F.col("total_cost_usd").alias("cost"))


def write_runs(runs: DataFrame, alerts: DataFrame, path: str, most_alerts: int = 50) -> None:
    """Runs and the newest alerts (at) as two tables."""
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    alerts.orderBy(F.desc("at")).limit(most_alerts).write.mode("overwrite").parquet(f"{path}/alerts")


def sample(spark: SparkSession, n: int, templates: list[tuple[str, str, str]], sources: tuple[str, ...] = ("OpenAI", "Anthropic", "Google"), seed: int = 42) -> DataFrame:
    """n made conversations: templates (title, text, domain) and sources in turn, days and scores by a seed; reruns agree."""
    rows = spark.range(n).withColumn("k", F.col("id") % len(templates))
    made = F.broadcast(spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "k long, title string, raw_text string, primary_domain string"))  # as many rows as templates
    pick = F.array(*[F.lit(s) for s in sources])
    number = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(m))
    rows = rows.join(made, "k").select(
        F.format_string("sample-%06d", "id").alias("convo_id"), F.element_at(pick, (F.col("id") % len(sources) + 1).cast("int")).alias("source"),
        F.timestamp_seconds(F.lit(1_704_067_200) + number(1, 365) * 86_400).alias("timestamp"), "title", "raw_text", "primary_domain", (number(2, 10) + 1).cast("int").alias("score"),
    )
    return rows


def chosen(df: DataFrame, ids: DataFrame, key: str = "id", id_col: str = "convo_id", other: str = "external_id") -> DataFrame:
    """The rows whose id, or else external id, is among ids."""
    name = F.coalesce(F.nullif(F.col(id_col), F.lit("")), F.col(other))
    return df.join(ids.select(F.col(key).alias("_wanted")).distinct(), name == F.col("_wanted"), "left_semi")


def members(groups: DataFrame, rows: DataFrame, group: str, ids: str, id_col: str) -> DataFrame:
    """(group, the columns of rows): what stored groups, with a list of ids each, refer to."""
    return rows.join(groups.select(group, F.explode(ids).alias(id_col)), id_col)
