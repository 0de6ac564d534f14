"""Dense vectors as array columns: cosine, exact top-k, centroids, coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_k(df: DataFrame, query: DataFrame, id_col: str, vec: str, k: int = 5, least: float = 0.0, exclude: DataFrame | None = None) -> DataFrame:
    """(id, similarity): query is one row with a column vec."""
    rows = df.join(exclude, id_col, "left_anti") if exclude is not None else df
    one = query.select(F.col(vec).alias("_q")).limit(1)
    found = rows.select(id_col, vec).join(F.broadcast(one)).select(id_col, cosine(F.col(vec), F.col("_q")).alias("similarity"))
    return found.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), id_col).limit(k)


def centroids(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    parts = df.select(*by, F.posexplode(vec).alias("_p", "_x")).groupBy(*by, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("centroid"))


def coherence(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """(cluster, n, coherence, spread): mean cosine to the centroid, and 1 - mean / max distance."""
    rows = df.join(F.broadcast(centroids(df, [cluster], vec)), cluster)
    away = F.sqrt(F.aggregate(F.zip_with(vec, "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = rows.select(cluster, cosine(F.col(vec), F.col("centroid")).alias("c"), away.alias("d"))
    return rows.groupBy(cluster).agg(F.count("*").alias("n"), F.avg("c").alias("coherence"), (1 - F.avg("d") / (F.max("d") + 1e-6)).alias("spread"))
