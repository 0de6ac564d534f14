"""Full-text search: a small query language, BM25 over fields, heuristic ranking, rank fusion, facets, suggestions."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P

TOKEN = r"([\p{L}\p{N}]+)"
K1, B = 1.2, 0.75


class Query(NamedTuple):
    terms: list[str]
    phrases: list[str]
    required: list[str]
    excluded: list[str]
    tags: list[str]


def parse(q: str, strip: bool = True) -> Query:
    """`"a phrase" +must -not tag:x plain`; plain terms lose punctuation and case."""
    phrases = [p.strip().lower() for p in re.findall(r'"([^"]+)"', q)]
    out = Query([], phrases, [], [], [])
    for word in re.sub(r'"[^"]*"', " ", q).split():
        kind = out.required if word[0] == "+" else out.excluded if word[0] == "-" else out.tags if word.startswith("tag:") else out.terms
        body = word[1:] if kind in (out.required, out.excluded) and word[0] in "+-" else word[4:] if kind is out.tags else word
        body = re.sub(r"[^\w-]", "", body).lower() if strip else body.lower()
        if body:
            kind.append(body)
    return out


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def matches(text: Column, q: Query) -> Column:
    """All positives hold (plain terms as prefixes of tokens), no negative does."""
    toks, low = tokens(text), F.lower(text)
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    cond = [F.contains(joined, F.lit(f" {t}")) for t in q.terms] + [F.array_contains(toks, t) for t in q.required]
    cond += [F.contains(joined, F.lit(" " + " ".join(re.findall(r"\w+", p)) + " ")) for p in q.phrases] + [~F.array_contains(toks, t) for t in q.excluded]
    return reduce(lambda a, b: a & b, cond, low.isNotNull())


def like(text: Column, q: Query) -> Column:
    low = F.lower(text)
    cond = [F.contains(low, F.lit(t)) for t in q.terms + q.phrases + q.required] + [~F.contains(low, F.lit(t)) for t in q.excluded]
    return reduce(lambda a, b: a & b, cond, F.lit(True))


def bm25(df: DataFrame, id_col: str, fields: dict[str, float], terms: list[str], every: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the rows that hold every term (or any). Only the terms' postings leave the scan.

    Term frequencies are weighted by field, lengths are not; the weight of a term is floored, as common terms would
    count against a row. Statistics are over all rows.
    """
    toks = {f: tokens(F.col(f)) for f in fields}
    size = reduce(lambda x, y: x + y, [F.size(t) for t in toks.values()])
    tf = lambda t: reduce(lambda x, y: x + y, [w * F.size(F.filter(toks[f], lambda v: v == t)) for f, w in fields.items()])
    rows = df.select(F.col(id_col), size.alias("_len"), *[tf(t).cast("double").alias(f"_t{k}") for k, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_t{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    joined = rows.filter(reduce((lambda x, y: x & y) if every else (lambda x, y: x | y), [F.col(f"_t{k}") > 0 for k in range(len(terms))])).join(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(terms)):
        t, d = F.col(f"_t{k}"), F.col(f"_d{k}")
        idf = F.greatest(F.log((F.col("_n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return joined.select(F.col(id_col), score.alias("score"))


def top(df: DataFrame, score: str, id_col: str, k: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(F.desc(score), id_col)
    return (out.offset(offset) if offset else out).limit(k)


def occurrences(text: Column, term: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term)))) / len(term)).cast("int")


def heuristic(text: Column, title: Column, q: Query) -> Column:
    """Counted terms, three times in the title; required terms and phrases must occur, excluded ones must not."""
    low, head = F.lower(text), F.lower(title)
    score = F.lit(0)
    for t in q.terms:
        score = score + occurrences(low, t) * F.when(F.contains(head, F.lit(t)), 3).otherwise(1)
    for t in q.required:
        score = score + 2 * occurrences(low, t)
    score = score + 5 * len(q.phrases)
    must = reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in q.required + q.phrases], F.lit(True))
    ban = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in q.excluded], F.lit(False))
    return F.when(must & ~ban, score).otherwise(0)


def expand(query: str) -> list[str]:
    """The words that stand for the same concepts as the query's."""
    low = query.lower()
    return [s for c, syn in P.SYNONYMS.items() if c in low or any(x in low for x in syn) for s in syn]


def synonym_score(text: Column, title: Column, query: str) -> Column:
    low, head, more = F.lower(text), F.lower(title), expand(query)
    score, hits = F.lit(0.0), F.lit(0)
    for w in query.lower().split():
        score = score + occurrences(low, w) * 5.0 * F.when(F.contains(head, F.lit(w)), 3.0).otherwise(1.0) * 3.0
    for w in more:
        score = score + occurrences(low, w) * 2.0 * F.when(F.contains(head, F.lit(w)), 1.5).otherwise(1.0)
        hits = hits + F.contains(low, F.lit(w)).cast("int")
    return F.when(hits > 2, score * 1.2).otherwise(score)


def rrf(left: DataFrame, right: DataFrame, id_col: str, k: int = 60, weights: tuple[float, float] = (0.5, 0.5), limit: int = 20) -> DataFrame:
    """(id, rank_left, rank_right, score): reciprocal rank fusion of two scored lists, cut at three times limit."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        few = df.orderBy(F.desc("score"), id_col).limit(3 * limit)
        return few.select(id_col, F.row_number().over(W.orderBy(F.desc("score"), id_col)).alias(name))

    both = ranked(left, "rank_left").join(ranked(right, "rank_right"), id_col, "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", part(weights[0], "rank_left") + part(weights[1], "rank_right"))
    return both.orderBy(F.desc("score"), F.asc_nulls_last("rank_left"), F.asc_nulls_last("rank_right")).limit(limit)


def highlight(text: Column, terms: list[str], mark: tuple[str, str] = ("<mark>", "</mark>")) -> Column:
    long = [re.sub(r"([^\w\s])", r"\\\1", t) for t in terms if len(t) > 1]
    return F.regexp_replace(text, F.lit("(?i)(" + "|".join(long) + ")"), F.lit(f"{mark[0]}$1{mark[1]}")) if long else text


def snippet(text: Column, term: str, before: int = 50, after: int = 100) -> Column:
    at = F.locate(term, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + len(term) - 1 + after, F.char_length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start + 1), F.when(end < F.char_length(text), "...").otherwise(""))
    return F.when(at > 0, cut)


def suggest(df: DataFrame, col: str, prefix: str, newest: str, k: int = 10) -> DataFrame:
    found = df.filter(F.startswith(F.lower(col), F.lit(prefix.lower())))
    return found.groupBy(col).agg(F.max(newest).alias("newest")).orderBy(F.desc("newest"), col).limit(k)


def facets(df: DataFrame, cols: list[str]) -> DataFrame:
    """(facet, value, n): the counts of each column's values in one pass."""
    sets = ", ".join(f"({c})" for c in cols)
    name = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in cols) + " END"
    value = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN cast({c} AS string)" for c in cols) + " END"
    return df.sparkSession.sql(f"SELECT {name} AS facet, {value} AS value, count(*) AS n FROM {{df}} GROUP BY GROUPING SETS ({sets})", df=df)
