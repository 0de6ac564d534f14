"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..workspace import materialize


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node u to the smaller node v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that stands on an edge; root is the smallest node that it reaches.

    Direction and repeats don't matter. An edge with a null end is left out; an edge from a node to itself says that
    the node exists. Every round shrinks the edges toward stars and is written to the shared folder, so that plans stay
    short. Minima are combined before each shuffle, so a hub sends one row a task. Works on any ordered node type.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    now = materialize(_down(pairs), "edges")
    was = None
    for _ in range(max_rounds):
        state = _state(now)
        if state == was:
            break
        was = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(_down(small), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(star, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
