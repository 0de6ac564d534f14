"""Chains of conversations and the projects that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P, text as T
from ..workspace import materialize
from . import context, vectors as V
from .components import connected_components

#: Kinds of chains, the stronger first, and windows in hours.
KINDS = ["continuation", "debug_session", "follow_up", "semantic_link"]
CONTINUES_WITHIN, FOLLOWS_WITHIN, SEMANTIC_WITHIN = 4, 24, 72


def continues(text: Column) -> Column:
    """True if a text says that it goes on from an earlier conversation."""
    return T.any_of(text, P.CONTINUATIONS)


def continuations(rows: DataFrame, entities: DataFrame, id_col: str, ts: str, text: str, entity: str) -> DataFrame:
    """(a, b, confidence): b refers back, and a came before it within four hours and shares an entity."""
    named = entities.select(id_col, entity).join(rows.select(id_col, ts), id_col)
    pairs = context.band_pairs(named, id_col, ts, entity, CONTINUES_WITHIN, 1)
    late = rows.filter(continues(F.col(text))).select(F.col(id_col).alias("b"))
    return pairs.join(late, "b", "left_semi").select("a", "b", F.lit(0.9).alias("confidence"))


def follow_ups(rows: DataFrame, entities: DataFrame, id_col: str, ts: str, entity: str, least: int = 2) -> DataFrame:
    """(a, b, confidence): pairs within a day that share entities; the more, the surer."""
    pairs = context.band_pairs(entities.select(id_col, entity).join(rows.select(id_col, ts), id_col), id_col, ts, entity, FOLLOWS_WITHIN, least)
    return pairs.select("a", "b", context.follow_up_confidence(F.col("shared")).alias("confidence"))


def semantic_pairs(rows: DataFrame, id_col: str, ts: str, vec: str, hours: float = SEMANTIC_WITHIN, least: float = 0.7, k: int = 5) -> DataFrame:
    """(a, b, similarity): for each row its k nearest others within so many hours, of at least that cosine.

    Rows meet by time: each goes to its own stretch of time and the next one, so only rows that can be near in time are
    compared. A stretch is dealt out in blocks, so that no task holds all rows of a busy one.
    """
    width = int(hours * 3_600_000_000)
    base = rows.select(F.col(id_col).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(vec).alias("v")).dropna()
    base = base.withColumns({"n": V.norm(F.col("v")), "s": F.floor(F.col("t") / width)}).filter("n > 0")
    sizes = base.groupBy("s").agg(F.ceil(F.count("*") / 2000).alias("blocks"))
    base = base.join(sizes, "s").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")))
    near = F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)
    here = base.select(F.explode(near).alias("s"), "id", "t", "v", "n")
    most = sizes.select("s", "blocks")
    here = here.join(most, "s").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    there = base.select("s", "blk", F.col("id").alias("id2"), F.col("t").alias("t2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    met = here.join(there, ["s", "blk"]).filter((F.col("id") != F.col("id2")) & (F.abs(F.col("t") - F.col("t2")) <= width))
    met = met.select(F.col("id").alias("a"), F.col("id2").alias("b"), (V.dot(F.col("v"), F.col("v2")) / (F.col("n") * F.col("n2"))).alias("similarity")).filter(F.col("similarity") >= least)
    best = met.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter(F.col("_r") <= k)
    return best.drop("_r")


def as_members(pairs: DataFrame, kind: str) -> DataFrame:
    """(chain, kind, member, confidence) of pairs (a, b, confidence): a pair is a chain of two."""
    named = pairs.select(F.concat(F.lit(f"{kind}:"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("chain"), F.lit(kind).alias("kind"), F.explode(F.array("a", "b")).alias("member"), "confidence")
    return named


def merge(members: DataFrame, entities: DataFrame, rows: DataFrame, id_col: str, ts: str, entity: str) -> DataFrame:
    """(chain, kind, size, confidence, members, shared, hours): chains that share a member are one, the longest first.

    The kind is the strongest among them, confidence the highest; shared entities are those that two members or more have.
    """
    members = materialize(members, "members")
    roots = context.merge_chains(members, "chain", "member")
    own = members.withColumn("member", F.col("member").cast("string")).join(roots, "member")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    heads = own.groupBy("root").agg(F.min_by("kind", place).alias("kind"), F.max("confidence").alias("confidence"))
    each = own.select("root", "member").distinct()
    times = rows.select(F.col(id_col).cast("string").alias("member"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    spans = each.join(times, "member").groupBy("root").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("member")).alias("members"), ((F.max("t") - F.min("t")) / 3.6e9).alias("hours"))
    named = entities.select(F.col(id_col).cast("string").alias("member"), F.col(entity).alias("e")).distinct().join(each, "member")
    shared = named.groupBy("root", "e").agg(F.count("*").alias("n")).filter("n >= 2").groupBy("root").agg(F.array_sort(F.collect_list("e")).alias("shared"))
    out = heads.join(spans, "root").join(shared, "root", "left").withColumn("chain", F.element_at("members", 1))
    out = out.select("chain", "kind", "size", "confidence", "members", F.coalesce("shared", F.array().cast(out.schema["shared"].dataType)).alias("shared"), "hours")
    return out.orderBy(F.desc("size"), "chain")


def detect(rows: DataFrame, entities: DataFrame, id_col: str, ts: str, text: str, entity: str, vec: str | None = None, errors: DataFrame | None = None) -> DataFrame:
    """All chains: explicit continuations, follow-ups, sessions on one error (id, error), near vectors; merged."""
    parts = [as_members(continuations(rows, entities, id_col, ts, text, entity), "continuation"), as_members(follow_ups(rows, entities, id_col, ts, entity), "follow_up")]
    if vec:
        near = semantic_pairs(rows, id_col, ts, vec).select("a", "b", F.col("similarity").alias("confidence"))
        parts.append(as_members(near, "semantic_link"))
    if errors is not None:
        own = errors.join(rows.select(id_col, ts), id_col)
        groups = context.shared_groups(own, id_col, ts, "error", SEMANTIC_WITHIN)
        parts.append(own.join(groups, "error").select(F.concat(F.lit("debug_session:"), "error").alias("chain"), F.lit("debug_session").alias("kind"), F.col(id_col).alias("member"), F.lit(0.85).alias("confidence")).distinct())
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    return merge(all_, entities, rows, id_col, ts, entity)


def related(rows: DataFrame, entities: DataFrame, key, id_col: str, ts: str, entity: str, k: int = 5, window: float = 24.0) -> DataFrame:
    """(id, shared, hours_apart, score, relation): the rows that share most with one and stand nearest to it in time."""
    one = rows.filter(F.col(id_col) == key).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).limit(1)
    mine = entities.filter(F.col(id_col) == key).select(entity).distinct()
    shared = entities.filter(F.col(id_col) != key).select(id_col, entity).distinct().join(F.broadcast(mine), entity).groupBy(id_col).agg(F.count("*").alias("shared"))
    others = rows.filter(F.col(id_col) != key).select(id_col, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).join(shared, id_col)
    hours = F.abs(F.col("t") - F.col("_t")) / 3.6e9
    out = others.join(F.broadcast(one)).select(id_col, "shared", hours.alias("hours_apart"), context.related_score(F.col("shared"), F.least(hours, F.lit(window))).alias("score"))
    label = F.when((F.col("shared") >= 2) & (F.col("hours_apart") <= window), "follow_up").otherwise("related")
    return out.withColumn("relation", label).orderBy(F.desc("score"), id_col).limit(k)


def signals(text: Column) -> Column:
    """(roots, repos, hosted, technologies, extensions): what in a text says which project it belongs to."""
    paths = T.all_matches(text, P.PATH, 1)
    home = F.regexp_extract  # of a path, the folder under a home, or the one under another known place
    root = lambda p: F.when(p.rlike(r"^/(?:home|Users)/[^/]+/[^/]+"), home(p, r"^(/(?:home|Users)/[^/]+/[^/]+)", 1)).when(p.rlike(r"^/(?:var|opt|srv|projects|repos|work|code)/[^/]+/."), home(p, r"^(/(?:var|opt|srv|projects|repos|work|code)/[^/]+)", 1))
    keep = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))
    techs = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(t)), F.lit(t)) for s in P.STACKS.values() for t in s]), lambda x: x.isNotNull())))
    ends = F.filter(F.transform(paths, lambda p: home(p, r"[^/.](\.[^./]+)$", 1)), lambda x: x != "")
    return F.struct(keep(F.transform(paths, root)).alias("roots"), keep(F.transform(T.all_matches(text, P.REPOSITORY, 1), F.lower)).alias("repos"), keep(F.transform(T.all_matches(text, P.HOSTED, 1), F.lower)).alias("hosted"), techs.alias("technologies"), ends.alias("extensions"))


def top_extensions(rows: DataFrame, text: str, k: int = 5) -> DataFrame:
    """(extension, n) of the paths in all texts."""
    ends = rows.select(F.explode(signals(F.col(text))["extensions"]).alias("extension"))
    return ends.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(k)


def projects(rows: DataFrame, id_col: str, text: str, least: int = 2, sure: float = 0.3) -> DataFrame:
    """(project, name, confidence, size, members, roots, technologies, keywords), the largest first.

    Roots that share half of the smaller one's members are one project. A name comes from a hosted repository, else a named
    one, else the shortest path; ties go by the alphabet. Confidence adds up size, names, paths and a coherent stack.
    """
    found = materialize(rows.select(id_col, signals(F.col(text)).alias("s")), "signals")
    marks = F.concat("s.roots", F.transform("s.repos", lambda x: F.concat(F.lit("repo:"), x)), F.transform("s.hosted", lambda x: F.concat(F.lit("git:"), x)))
    own = materialize(found.select(id_col, F.explode(marks).alias("root"), F.col("s.technologies").alias("t")), "roots")
    pairs = context.overlapping_roots(own, "root", id_col)
    joined = connected_components(pairs.select("a", "b"), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("project"))
    own = own.join(joined, "root", "left").withColumn("project", F.coalesce("project", "root"))
    each = own.groupBy("project").agg(F.array_sort(F.collect_set(F.col(id_col))).alias("members"), F.array_sort(F.collect_set("root")).alias("roots"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))).alias("technologies"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    order = F.transform("roots", lambda r: F.struct(F.when(r.startswith("git:"), 0).when(r.startswith("repo:"), 1).otherwise(2).alias("k"), F.when(r.startswith("/"), F.length(r)).otherwise(0).alias("l"), r.alias("r")))
    best = F.array_min(order)["r"]
    n = F.size("members")
    named = F.exists("roots", lambda r: r.startswith("git:") | r.startswith("repo:"))
    stack = F.lit(False)
    for s in P.STACKS.values():
        stack = stack | (F.size(F.array_intersect("technologies", F.array(*[F.lit(t) for t in s]))) >= 2)
    points = F.when(n >= 5, 3).when(n >= 3, 2).when(n >= 2, 1).otherwise(0) + F.when(named, 3).otherwise(0) + F.when(F.exists("roots", lambda r: r.startswith("/")), 2).otherwise(0) + F.when(stack, 2).otherwise(0)
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("roots", lambda r: F.when(r.startswith("git:"), F.split(F.substring(r, 5, 1000), "/")).when(r.startswith("repo:"), F.array(F.substring(r, 6, 1000))).otherwise(F.array(base(r)))))))
    out = each.select("project", base(F.regexp_replace(best, "^(git:|repo:)", "")).alias("name"), F.least(points / 10, F.lit(1.0)).alias("confidence"), n.alias("size"), "members", "roots", "technologies", words.alias("keywords"))
    return out.filter((F.col("size") >= least) & (F.col("confidence") >= sure)).orderBy(F.desc("size"), "project")


def by_project(rows: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(name, the columns of rows): the conversations of each project."""
    return rows.join(found.select("name", F.explode("members").alias(id_col)), id_col)
