"""Incremental ingestion: file sources, event time, deduplication, side outputs for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..workspace import new_path


def stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(folder)


def since(df: DataFrame, known: DataFrame, key: list[str], ts: str, cursor) -> DataFrame:
    """The batch form of a cursor: rows after it, or without a time, whose key is not known."""
    new = df if cursor is None else df.filter((F.col(ts) > F.lit(cursor)) | F.col(ts).isNull())
    return new.join(known.select(*key).distinct(), key, "left_anti")


def ingest(df: DataFrame, key: list[str], ts: str, target: str, delay: str = "30 days") -> StreamingQuery:
    """Appends each key once to a Parquet table, with state bounded by the watermark; stops when all input is read."""
    seen = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    where = f"{target}_checkpoint"
    return seen.writeStream.format("parquet").option("path", target).option("checkpointLocation", where).trigger(availableNow=True).outputMode("append").start()


def split_late(df: DataFrame, ts: str, bound, target: str, late: str) -> StreamingQuery:
    """Rows older than the bound go to a table of their own instead of being lost."""

    def write(batch: DataFrame, no: int) -> None:
        batch.filter(F.col(ts) >= F.lit(bound)).write.mode("append").parquet(target)
        batch.filter(~(F.col(ts) >= F.lit(bound)) | F.col(ts).isNull()).write.mode("append").parquet(late)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}_checkpoint").trigger(availableNow=True).start()


def windowed(df: DataFrame, ts: str, width: str, by: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str]) -> DataFrame:
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def ingested(spark: SparkSession, folder: str, key: list[str], ts: str) -> DataFrame:
    """Runs a whole ingestion of a folder into the shared folder and gives the table."""
    schema = spark.read.parquet(folder).schema
    target = new_path(spark, "ingested")
    ingest(stream(spark, folder, schema), key, ts, target).awaitTermination()
    return spark.read.parquet(target)
