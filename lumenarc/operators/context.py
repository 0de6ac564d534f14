"""Conversations that belong together: band joins over time with shared entities, chains, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components


def band_pairs(rows: DataFrame, id_col: str, ts: str, entity: str, hours: float, least: int = 2) -> DataFrame:
    """(a, b, shared, hours_apart): b is later by at most so many hours, and they share at least so many entities.

    An equality on entity and time bucket, never a bare inequality: the earlier row goes to its own bucket and the next.
    """
    width = int(hours * 3_600_000_000)
    base = rows.select(F.col(id_col).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(entity).alias("e")).dropna().distinct()
    bucket = F.floor(F.col("t") / width)
    early = base.select(F.col("id").alias("a"), F.col("t").alias("ta"), "e", F.explode(F.array(bucket, bucket + 1)).alias("k"))
    late = base.select(F.col("id").alias("b"), F.col("t").alias("tb"), "e", bucket.alias("k"))
    met = early.join(late, ["e", "k"]).filter(((F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))) & (F.col("tb") - F.col("ta") <= width))
    out = met.groupBy("a", "b").agg(F.count_distinct("e").alias("shared"), F.min((F.col("tb") - F.col("ta")) / 3.6e9).alias("hours_apart"))
    return out.filter(F.col("shared") >= least)


def related_score(shared: Column, hours: Column) -> Column:
    return 0.5 * shared + 0.5 * (1 - hours / 24)


def follow_up_confidence(shared: Column) -> Column:
    return F.least(0.5 + 0.1 * shared, F.lit(0.9))


def shared_groups(rows: DataFrame, id_col: str, ts: str, key: str, hours: float) -> DataFrame:
    """(key, n, hours): groups with one key that two or more rows share within a span."""
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 3.6e9
    return rows.groupBy(key).agg(F.count_distinct(id_col).alias("n"), span.alias("hours")).filter((F.col("n") >= 2) & (F.col("hours") <= hours))


def merge_chains(members: DataFrame, chain: str, member: str) -> DataFrame:
    """(member, root): chains that share a member are one."""
    ids = members.select(F.concat(F.lit("c"), F.col(chain).cast("string")).alias("c"), F.concat(F.lit("m"), F.col(member).cast("string")).alias("m"))
    found = connected_components(ids, "c", "m")
    return found.filter(F.startswith("node", F.lit("m"))).select(F.substring("node", 2, 1 << 20).alias("member"), "root")


def overlapping_roots(rows: DataFrame, root: str, member: str, share: float = 0.5) -> DataFrame:
    """(a, b, shared): roots that share at least that part of the smaller one's members."""
    base = rows.select(F.col(root).alias("r"), F.col(member).alias("m")).dropna().distinct()
    size = base.groupBy("r").agg(F.count("*").alias("n"))
    pair = base.select(F.col("r").alias("a"), "m").join(base.select(F.col("r").alias("b"), "m"), "m").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pair = pair.join(size.select(F.col("r").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("r").alias("b"), F.col("n").alias("nb")), "b")
    return pair.filter(F.col("shared") >= share * F.least("na", "nb")).select("a", "b", "shared")
