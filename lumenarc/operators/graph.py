"""Co-occurrence graphs: nodes, weighted edges, neighbours, paths, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .components import connected_components

#: Entities of one group that meet in one array, at most twice as many.
BLOCK = 256


def edges(rows: DataFrame, group: str, entity: str) -> DataFrame:
    """(a, b, groups, weight): pairs a < b that share groups; weight is 1 + the number of groups.

    Group members meet in arrays of their distinct entities, so only real pairs are made. A group with more than BLOCK
    entities is dealt out as pairs of blocks: no array holds more than two blocks of it.
    """
    own = rows.select(group, entity).dropna().distinct()
    blocks = own.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    own = own.join(blocks, group).withColumn("_k", F.pmod(F.xxhash64(entity), F.col("_n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    dealt = own.withColumn("_o", other).groupBy(group, F.least("_k", "_o").alias("_a"), F.greatest("_k", "_o").alias("_b"))
    sets = dealt.agg(F.sort_array(F.collect_list(F.struct(F.col(entity).alias("v"), F.col("_k").alias("k")))).alias("e"))
    met = lambda x, y: (F.col("_a") == F.col("_b")) | (x["k"] != y["k"])
    others = lambda x, i: F.filter(F.slice("e", i + 2, F.size("e")), lambda y: met(x, y))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(others(x, i), lambda y: F.struct(x["v"].alias("a"), y["v"].alias("b")))))
    out = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("groups"))
    return out.withColumn("weight", (F.col("groups") + 1).cast("double"))


def nodes(rows: DataFrame, group: str, entity: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.count("*").alias("mentions"), F.count_distinct(group).alias("groups"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b", "weight").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def related(e: DataFrame, name, k: int = 10, least: float = 0.0) -> DataFrame:
    return both_ways(e).filter((F.col("a") == F.lit(name)) & (F.col("weight") >= least)).select(F.col("b").alias("entity"), "weight").orderBy(F.desc("weight"), "entity").limit(k)


def visible(n: DataFrame, e: DataFrame, entity: str, most_nodes: int = 100, most_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a drawing shows; an edge needs both its ends."""
    few = n.filter("mentions >= 2").orderBy(F.desc("mentions"), entity).limit(most_nodes).withColumn("size", F.log(F.col("mentions") + 1) * 10)
    ids = few.select(F.col(entity).alias("_x"))
    kept = e.filter("weight >= 2").join(F.broadcast(ids), F.col("a") == F.col("_x"), "left_semi").join(F.broadcast(ids), F.col("b") == F.col("_x"), "left_semi")
    return few, kept.orderBy(F.desc("weight"), "a", "b").limit(most_edges)


def paths(e: DataFrame, start, end, depth: int = 3, limit: int = 10) -> DataFrame:
    """(path): the simple paths of at most depth edges, shortest first."""
    step = both_ways(e).select("a", "b")
    now = e.sparkSession.createDataFrame([(start, [start])], f"at {e.schema['a'].dataType.simpleString()}, path array<{e.schema['a'].dataType.simpleString()}>")
    found = None
    for _ in range(depth):
        now = now.join(step, F.col("at") == F.col("a")).filter(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        done = now.filter(F.col("at") == F.lit(end)).select("path")
        found = done if found is None else found.union(done)
        now = now.filter(F.col("at") != F.lit(end))
    return found.orderBy(F.size("path"), "path").limit(limit)


def clusters(e: DataFrame, least_weight: float = 3.0, least_size: int = 3) -> DataFrame:
    """(root, size, members) of the components over heavy edges."""
    c = connected_components(e.filter(F.col("weight") >= least_weight), "a", "b")
    return c.groupBy("root").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members")).filter(F.col("size") >= least_size)
