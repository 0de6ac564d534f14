"""Evaluation: feedback, click-through, ranked lists, tag overlap, health, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def feedback(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    out = df.withColumn("_v", value).groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("_v") > 0).alias("positive"), F.count_if(F.col("_v") < 0).alias("negative"), F.count_if(F.col("_v") == 0).alias("neutral"), F.avg("_v").alias("mean"))
    return out.withColumn("satisfaction", F.col("positive") / F.col("total")).withColumn("status", health(F.col("satisfaction")))


def health(satisfaction: Column) -> Column:
    return F.when(satisfaction.isNull(), "unknown").when(satisfaction >= 0.7, "healthy").when(satisfaction >= 0.56, "degraded").otherwise("critical")


def click_through(df: DataFrame, by: list[str], kind: Column) -> DataFrame:
    out = df.withColumn("_k", kind).groupBy(*by).agg(F.count_if(F.col("_k").isin("view", "show")).alias("views"), F.count_if(F.col("_k") == "click").alias("clicks"))
    return out.withColumn("ctr", F.when(F.col("views") > 0, F.col("clicks") / F.col("views")).otherwise(0.0))


def ranked(lists: DataFrame, session: str, position: str, clicked: str) -> DataFrame:
    """(session, n, clicks, precision, mrr, ndcg) of lists with one row a position (from 1)."""
    hit = F.col(clicked).cast("int")
    out = lists.groupBy(session).agg(F.count("*").alias("n"), F.sum(hit).alias("clicks"), F.coalesce(F.max(F.when(F.col(clicked), 1 / F.col(position))), F.lit(0.0)).alias("mrr"), F.sum(hit / F.log2(F.col(position) + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("clicks", F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / F.log2(k + 1))
    return out.select(session, "n", "clicks", (F.col("clicks") / F.col("n")).alias("precision"), "mrr", F.when(F.col("clicks") > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"))


def tag_scores(predicted: Column, truth: Column) -> list[Column]:
    """precision, recall and F1 of two lists of tags; two empty lists agree."""
    a, b = (F.array_distinct(F.transform(x, F.lower)) for x in (predicted, truth))
    both = F.size(F.array_intersect(a, b))
    none = (F.size(a) == 0) & (F.size(b) == 0)
    p = F.when(none, 1.0).when(F.size(a) == 0, 0.0).otherwise(both / F.size(a))
    r = F.when(none, 1.0).when(F.size(b) == 0, 0.0).otherwise(both / F.size(b))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def shared_entities(rows: DataFrame, id_col: str, entity: str, seed, k: int = 5) -> DataFrame:
    """(id, shared, score): rows that share the most entities with one, as a part of the best."""
    own = rows.filter(F.col(id_col) == F.lit(seed)).select(entity).distinct()
    met = rows.filter(F.col(id_col) != F.lit(seed)).select(id_col, entity).distinct().join(F.broadcast(own), entity, "left_semi")
    few = met.groupBy(id_col).agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), id_col).limit(k)
    return few.join(F.broadcast(few.agg(F.max("shared").alias("_m")))).select(id_col, "shared", (F.col("shared") / F.col("_m")).alias("score"))
