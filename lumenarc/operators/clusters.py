"""Clusters of vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F


def kmeans(df: DataFrame, id_col: str, vec: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means; k is a third of the rows, at least 2 and at most 10, unless given.

    Null and empty vectors take no part. Fewer than two vectors are one cluster, 0.
    """
    rows = df.select(id_col, vec).filter(F.size(vec) > 0)
    n = rows.count()
    if n < 2:
        return rows.select(id_col, F.lit(0).alias("cluster"))
    rows = rows.select(id_col, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k or max(2, min(10, n // 3)), seed=seed).fit(rows)
    return model.transform(rows).select(id_col, F.col("prediction").alias("cluster"))
