"""Entities that texts name, the graph that they make, and what it recommends."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P, text as T
from ..workspace import materialize
from . import graph

#: Which kind a name stands for if several have it.
PRIORITY = ["technology", "concept", "error", "file", "pattern"]


def named(text: Column, most_files: int = 10) -> Column:
    """Array of (kind, name): technologies and concepts by presence, error names in lower case, the first file names."""
    as_kind = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    errors = F.array_distinct(F.transform(T.all_matches(text, P.ERROR_NAME, 1), F.lower))
    files = F.array_distinct(F.slice(T.all_matches(text, P.FILE_NAME), 1, most_files))
    return F.concat(as_kind("technology", T.which(text, P.TECHNOLOGIES)), as_kind("concept", T.which(text, P.CONCEPT_WORDS)), as_kind("error", errors), as_kind("file", files))


def extract(rows: DataFrame, id_col: str, text: str, terms: str | None = None, languages: str | None = None) -> DataFrame:
    """(id, kind, name, in_text): the entities of each row; terms and languages from enrichment are not in_text."""
    found = rows.select(id_col, F.explode(named(F.col(text))).alias("e")).select(id_col, "e.kind", "e.name", F.lit(True).alias("in_text"))
    for col, kind in ((terms, "concept"), (languages, "technology")):
        if col:
            found = found.unionByName(rows.select(id_col, F.lit(kind).alias("kind"), F.explode(F.transform(col, F.lower)).alias("name"), F.lit(False).alias("in_text")))
    return found


def build(found: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (kind, name, mentions, groups), edges (a, b, groups, weight) over names found in texts.

    An edge joins nodes by name; the name stands for the kind that comes first in PRIORITY.
    """
    found = materialize(found, "entities")
    nodes = found.groupBy("kind", "name").agg(F.count("*").alias("mentions"), F.count_distinct(id_col).alias("groups"))
    return nodes, graph.edges(found.filter("in_text"), id_col, "name")


def resolve(nodes: DataFrame) -> DataFrame:
    """(name, kind): the one kind that each name stands for."""
    place = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind"))
    return nodes.groupBy("name").agg(F.min_by("kind", place).alias("kind"))


def kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def report(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(section, name, n): counts by kind, the top names of each kind, and the heaviest edges."""
    by_kind = kinds(nodes).select(F.lit("kinds").alias("section"), F.col("kind").alias("name"), "n")
    top = nodes.withColumn("_r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("mentions"), "name"))).filter(F.col("_r") <= k)
    top = top.select(F.col("kind").alias("section"), "name", F.col("mentions").alias("n"))
    heavy = edges.orderBy(F.desc("groups"), "a", "b").limit(k).select(F.lit("edges").alias("section"), F.concat_ws(" - ", "a", "b").alias("name"), F.col("groups").alias("n"))
    return by_kind.unionByName(top).unionByName(heavy)


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two tables under path."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


_GRAPH = "entities array<struct<id:string,name:string,type:string,count:long,conversations:array<string>>>, relationships array<struct<source:string,target:string,type:string,weight:double,conversations:array<string>>>"


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph kept as one JSON document."""
    doc = spark.read.schema(_GRAPH).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("entities").alias("e")).select(F.col("e.type").alias("kind"), "e.name", F.col("e.count").alias("mentions"), F.size("e.conversations").cast("long").alias("groups"))
    ends = doc.select(F.explode("relationships").alias("r")).select(F.col("r.source").alias("a"), F.col("r.target").alias("b"), F.size("r.conversations").cast("long").alias("groups"), "r.weight")
    return nodes, ends


def inverted(rows: DataFrame, id_col: str, lists: dict[str, str], domain: str | None = None) -> DataFrame:
    """(kind, value, id): which rows have each tag, language, term or domain, in lower case; lists names the array columns."""
    out = None
    for kind, col in lists.items():
        part = rows.select(F.lit(kind).alias("kind"), F.explode(F.transform(col, F.lower)).alias("value"), id_col)
        out = part if out is None else out.unionByName(part)
    if domain:
        part = rows.filter(F.coalesce(F.col(domain), F.lit("")) != "").select(F.lit("domain").alias("kind"), F.lower(domain).alias("value"), id_col)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def by_entity(index: DataFrame, rows: DataFrame, id_col: str, value: str, kind: str = "tag", score: str = "score", limit: int = 10) -> DataFrame:
    """(id, score): the best rows that have an entity; all are ordered before the cut."""
    ids = index.filter((F.col("kind") == kind) & (F.col("value") == value.lower())).select(id_col)
    found = rows.join(ids, id_col, "left_semi").select(id_col, (F.coalesce(F.col(score), F.lit(50)) / 100.0).alias("score"))
    return found.orderBy(F.desc("score"), id_col).limit(limit)


def from_history(index: DataFrame, history: DataFrame, id_col: str, limit: int = 10, use: tuple[str, ...] = ("tag", "lang")) -> DataFrame:
    """(id, matches, score): other rows by how many tags and languages they share with a history; score over the best."""
    own = index.filter(F.col("kind").isin(*use))
    wanted = own.join(history.select(id_col).distinct(), id_col, "left_semi").select("kind", "value").distinct()
    found = own.join(wanted, ["kind", "value"]).join(history.select(id_col).distinct(), id_col, "left_anti").groupBy(id_col).agg(F.count("*").alias("matches"))
    best = found.agg(F.max("matches").alias("_m"))  # one row
    return found.orderBy(F.desc("matches"), id_col).limit(limit).join(F.broadcast(best)).select(id_col, "matches", (F.col("matches") / F.col("_m")).alias("score")).orderBy(F.desc("matches"), id_col)


def to_document(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph that a drawing shows as one JSON document; for what graph.visible() leaves, which is bounded."""
    as_rows = lambda df: [r.asDict(recursive=True) for r in df.limit(1000).collect()]
    return json.dumps({"nodes": as_rows(nodes), "edges": as_rows(edges)}, ensure_ascii=False, default=str)
