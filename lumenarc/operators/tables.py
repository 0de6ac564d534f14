"""Tables: upserts, deletes, anti-joins, paging, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*newest))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those that share their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def unseen(new: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key known doesn't have, each key once."""
    return new.join(known.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a table knows; others are dropped."""
    return df.select([c for c in columns if c in df.columns])


def paged_names(df: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, title) by lower-cased title, for an index file."""
    return df.select(key, F.coalesce(F.nullif(name, F.lit("")), F.lit("Untitled")).alias("title")).orderBy(F.lower("title"), key)
