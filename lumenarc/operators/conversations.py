"""Conversations as a table: filters, one search call, shaped rows, sort modes, statistics of the whole."""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from . import index as I, search as S, vectors as V


class Filters(NamedTuple):
    """What a row must have; None asks for nothing. Bounds of dates are whole days, both included."""

    source: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_score: float | None = None
    max_score: float | None = None
    tags: tuple[str, ...] = ()
    domain: str | None = None
    has_code: bool | None = None
    has_links: bool | None = None


def condition(f: Filters, source: str = "source", ts: str = "timestamp", score: str = "score", tags: str = "tags", domain: str = "primary_domain") -> Column:
    """The filters as one condition, so that the scan sees them. Tags match in any case; one of them suffices."""
    out = []
    if f.source is not None:
        out.append(F.col(source) == f.source)
    if f.domain is not None:
        out.append(F.col(domain) == f.domain)
    if f.date_from is not None:
        out.append(F.col(ts) >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to is not None:
        out.append(F.col(ts) < F.date_add(F.lit(f.date_to).cast("date"), 1).cast("timestamp"))
    if f.min_score is not None:
        out.append(F.col(score) >= f.min_score)
    if f.max_score is not None:
        out.append(F.col(score) <= f.max_score)
    if f.tags:
        out.append(F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(t.lower()) for t in f.tags])))
    for name, wanted in (("has_code", f.has_code), ("has_links", f.has_links)):
        if wanted is not None:
            out.append(F.col(name) == wanted)
    return reduce(lambda a, b: a & b, out, F.lit(True))


def count(df: DataFrame, f: Filters, **names: str) -> DataFrame:
    """(n): how many rows the filters leave."""
    return df.filter(condition(f, **names)).agg(F.count("*").alias("n"))


def with_text(df: DataFrame, q: str, cols: list[str], every: bool = False) -> DataFrame:
    """Rows where one of the columns (arrays joined by spaces), or with `every` all of them as one text, holds q in any case."""
    text = [F.array_join(c, " ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") for c in cols]
    text = [F.concat_ws(" ", *text)] if every else text
    hit = [F.coalesce(F.contains(F.lower(t), F.lit(q.lower())), F.lit(False)) for t in text]
    return df.filter(reduce(lambda a, b: a | b, hit))


def dated(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from the start of one day to the end of another; times that can't be read are dropped."""
    at = F.coalesce(F.try_to_timestamp(F.col(ts).cast("string"), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")), F.col(ts).try_cast("timestamp"))
    return df.filter((at >= F.lit(start).cast("timestamp")) & (at < F.date_add(F.lit(end).cast("date"), 1)))


def worth_enriching(text: Column, messages: Column, least_chars: int = 100, least_messages: int = 2) -> Column:
    return (F.char_length(text) >= least_chars) & (messages >= least_messages)


def needs_tags(tags: Column, source: Column, sources: list[str]) -> Column:
    return (F.coalesce(F.size(tags), F.lit(0)) <= 0) & source.isin(sources)


def artifacts_of(df: DataFrame, conversation=None, kind: str | None = None, language: str | None = None, limit: int = 100) -> DataFrame:
    """Artifacts by conversation, type or language, the newest first."""
    for name, wanted in (("convo_id", conversation), ("artifact_type", kind), ("language", language)):
        df = df if wanted is None else df.filter(F.col(name) == wanted)
    return df.orderBy(F.desc("created_at"), "artifact_id").limit(limit)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that keep all rules, and the others with `broken`, the names of those that they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def detail(df: DataFrame, key, related: DataFrame | None = None, id_col: str = "convo_id", other: str = "external_id", most: int = 5) -> DataFrame:
    """The row of one conversation, by either id, and in `related` its nearest others from related (convo_id, other, score)."""
    one = df.filter((F.col(id_col) == key) | (F.col(other) == key)).orderBy(F.col(id_col) != key).limit(1)
    if related is None:
        return one
    near = related.join(F.broadcast(one.select(id_col)), id_col, "left_semi").withColumn("_r", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("score"), "other")))
    near = near.filter(F.col("_r") <= most).groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "other"))), lambda x: x["other"]).alias("related"))
    return one.join(F.broadcast(near), id_col, "left")


def malformed_tag(tag: Column) -> Column:
    return (F.char_length(tag) < 2) | tag.rlike(r"[\[\]\"']")


def tag_cloud(tags: DataFrame, tag: str = "tag", least: int = 5, most: int = 50) -> DataFrame:
    """(tag, n, size): the commonest well-formed tags, their size 1 to 5 by the share of the commonest."""
    rows = tags.filter(~malformed_tag(F.col(tag))).groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = rows.orderBy(F.desc("n"), "tag").limit(most)
    return rows.withColumn("size", F.least(F.ceil(F.col("n") / F.max("n").over(W.partitionBy()) * 5), F.lit(5)))


def shape(df: DataFrame, title: Column, summary: Column, text: Column, tags: Column, ts: Column) -> DataFrame:
    """df with title, summary, text, tags and date as a list of results shows them."""
    cut = F.when(F.char_length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
    said = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    return df.withColumns({"title": said, "summary": F.substring(F.coalesce(summary, F.lit("")), 1, 300), "text": F.coalesce(cut, F.lit("")), "tags": F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5), "date": F.substring(ts.cast("string"), 1, 10)})


def matched_terms(q: str, title: Column, summary: Column) -> Column:
    """The words of a query that occur in title or summary, in the query's order."""
    low = F.lower(F.concat_ws(" ", title, summary))
    return F.filter(F.array(*[F.lit(w) for w in q.lower().split()]).cast("array<string>"), lambda w: F.contains(low, w))


def shown_relevance(score: Column) -> Column:
    """A score as a number between 0 and 1; order is taken before."""
    return 1 / (1 + F.abs(score) / 10)


def marked(title: Column, summary: Column, terms: list[str]) -> Column:
    """(title, summary) with the first term of the title in asterisks and a snippet of the summary round its first term."""
    head, snip = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t in terms[::-1]:
        quoted = re.sub(r"([^\w\s])", r"\\\1", t)
        head = F.when(F.contains(F.lower(title), F.lit(t.lower())), F.regexp_replace(title, F.lit(f"(?i)({quoted})"), F.lit("**$1**"))).otherwise(head)
        snip = F.when(F.contains(F.lower(summary), F.lit(t.lower())), S.snippet(summary, t.lower())).otherwise(snip)
    return F.struct(head.alias("title"), snip.alias("summary"))


def hybrid_score(lexical: DataFrame, semantic: DataFrame, mode: str, limit: int, k: int = 60) -> DataFrame:
    """(doc, score) of one mode: bm25, semantic (0.3 to 0.7 in favour of vectors) or hybrid (half and half)."""
    if mode == "bm25":
        return lexical.orderBy(F.desc("score"), "doc").limit(limit)
    if mode not in ("semantic", "hybrid"):
        raise ValueError(f"no search mode {mode}")
    weights = (0.3, 0.7) if mode == "semantic" else (0.5, 0.5)
    return S.rrf(lexical, semantic, "doc", k, weights, limit).select("doc", "score")


def find(spark: SparkSession, idx: I.Index, docs: DataFrame, id_col: str, q: str, f: Filters = Filters(), weights: dict[str, float] | None = None, page: int = 1, size: int = 50, every: bool = True, ts: str = "timestamp", k1: float = S.K1, b: float = S.B, **names: str) -> DataFrame:
    """(rank, total, relevance, the columns of docs): one page of the search, the best first, ties to the smaller id.

    The query is parsed; tags in it join the filters; filters hold before ranking. Without positive parts the filtered rows
    come newest first with relevance 0. total is the number of all that match, beyond the page too.
    """
    parsed = S.parse(q)
    f = f._replace(tags=(*f.tags, *parsed.tags))
    rows = docs.filter(condition(f, ts=ts, **names))
    if parsed.terms or parsed.required or parsed.phrases:
        weights = weights or I.FIELDS
        found = I.score(spark, idx, parsed, weights, every, k1=k1, b=b).select(F.col("doc").alias(id_col), F.col("score").alias("relevance"))
        rows = rows.join(found, id_col)
        order = [F.desc("relevance"), F.col(id_col)]
    else:
        if parsed.excluded:
            bad = spark.read.parquet(f"{idx.path}/postings").filter(F.col("term").isin([I._term(idx, t) for t in parsed.excluded]))
            rows = rows.join(bad.select(F.col("doc").alias(id_col)), id_col, "left_anti")
        rows = rows.withColumn("relevance", F.lit(0.0))
        order = [F.desc(ts), F.col(id_col)]
    total = rows.agg(F.count("*").alias("total"))  # one row
    few = rows.orderBy(*order).limit(page * size).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    few = few.filter(F.col("rank") > (page - 1) * size).join(F.broadcast(total))
    return few.select("rank", "total", *[c for c in few.columns if c not in ("rank", "total")])


def semantic(docs: DataFrame, query: DataFrame, id_col: str, vec: str, limit: int, f: Filters = Filters(), least: float = 0.3, **names: str) -> DataFrame:
    """(id, similarity, the columns of docs): the nearest rows that keep the filters; similarity to three places."""
    rows = docs.filter(condition(f, **names))
    found = V.top_k(rows, query, id_col, vec, min(limit, 50), least)
    return rows.join(F.broadcast(found), id_col).withColumn("similarity", F.round("similarity", 3))


SORTS: dict[str, tuple[str, bool]] = {"date-desc": ("timestamp", False), "date-asc": ("timestamp", True), "score-desc": ("score", False), "score-asc": ("score", True), "title-asc": ("title", True), "title-desc": ("title", False)}


def sort_by(mode: str, names: dict[str, str] | None = None, id_col: str = "convo_id") -> list[Column]:
    """The columns of a named order; one that is not known sorts by date, the newest first. Nothing is taken from outside.

    `relevance` goes by search score in bands of half a point, then quality, then date.
    """
    names = names or {}
    if mode == "relevance":
        return [F.desc(F.floor(F.col("relevance") * 10 / 5)), F.desc(names.get("score", "score")), F.desc(names.get("timestamp", "timestamp")), F.col(id_col)]
    key, up = SORTS.get(mode, SORTS["date-desc"])
    name = names.get(key, key)
    by = F.lower(name) if key == "title" else F.col(name)
    return [by.asc_nulls_last() if up else by.desc_nulls_last(), F.col(id_col)]


def suggest_titles(df: DataFrame, title: str, q: str, n: int = 10) -> DataFrame:
    """(title): titles that hold q, of two letters or more, cut at 100, in their order."""
    if len(q) < 2:
        return df.select(F.substring(title, 1, 100).alias("title")).limit(0)
    return df.filter(F.contains(F.lower(title), F.lit(q.lower()))).select(F.substring(title, 1, 100).alias("title")).distinct().orderBy("title").limit(n)


def with_day_headers(df: DataFrame, ts: str, *order: Column) -> DataFrame:
    """df with day, and header where a row's day is another than that of the row before. For lists that are shown, so short."""
    rows = df.withColumn("day", F.to_date(ts))
    last = F.lag("day").over(W.orderBy(*order))
    return rows.withColumn("header", last.isNull() | (last != F.col("day")))


def pages(n: int, size: int) -> int:
    return math.ceil(n / size)
