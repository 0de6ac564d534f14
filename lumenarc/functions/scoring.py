"""Quality scores of conversations: five dimensions, their weighted sum, a grade and a percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..workspace import materialize, small_enough
from . import patterns as P, text as T


def _steps(n: Column, *steps: tuple[int, int]) -> Column:
    """The points of the first bound that n reaches."""

    def ladder(x: Column) -> Column:
        out = F.lit(0)
        for bound, points in reversed(steps):
            out = F.when(x >= bound, points).otherwise(out)
        return out

    return F.get(F.transform(F.array(n), ladder), F.lit(0))  # n is computed once, however many steps there are


def _if(c: Column, points: int) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)


def _words(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")))


def technical_depth(text: Column, terms: Column) -> Column:
    lines = F.aggregate(F.transform(T.code_blocks(text), lambda b: F.size(F.split(b, "\n"))), F.lit(0), lambda a, x: a + x)
    return F.least(F.lit(100), 30 + _steps(T.how_many(text, P.ADVANCED), (3, 30), (1, 15)) + _steps(lines, (51, 20), (21, 10)) + _steps(F.size(terms), (11, 15), (6, 8)) + _if(T.any_of(text, P.ERRORS), 5))


def practical_value(text: Column) -> Column:
    return F.least(F.lit(100), 25 + _steps(T.how_many(text, P.PRACTICAL), (5, 35), (3, 20), (1, 10)) + _if(F.size(T.code_blocks(text)) > 0, 15) + _if(text.rlike(r"(?i)\boutput\b|\bresult\b"), 10) + _if(text.rlike(r"(?i)\bsolution\b|\bsolved\b|\bfixed\b|\bworking\b"), 10) + _if(F.size(T.urls(text)) > 0, 5))


def completeness(text: Column, turns: Column, has_summary: Column) -> Column:
    done = F.right(text, F.lit(500)).rlike(r"(?i)\bthank|\bperfect\b|\bworks\b|\bgreat\b|\bsolved\b")
    return F.least(F.lit(100), 40 + _steps(_words(text), (2001, 25), (1001, 15), (501, 5)) + _if(turns >= 5, 10) + _if(done, 15) + _if(has_summary, 10))


def clarity(text: Column) -> Column:
    parts = F.split(text, r"[.!?]+")
    mean = F.aggregate(F.transform(parts, _words), F.lit(0), lambda a, x: a + x) / F.size(parts)
    examples = F.regexp_count(text, F.lit(r"(?i)\bexample\b"))
    return F.least(F.lit(100), 35 + _steps(T.how_many(text, P.CLARITY), (5, 30), (3, 20), (1, 10)) + _steps(examples, (2, 15), (1, 8)) + _if(text.rlike(r"(?m)^\s*(?:[-*•]|\d+\.)\s+"), 10) + _if(mean < 20, 5))


def uniqueness(text: Column, rare_terms: Column) -> Column:
    return F.least(F.lit(100), 50 + _steps(rare_terms, (3, 25), (1, 10)) + _if(text.rlike(r"(?i)\bnovel\b|\bunique\b|\binnovative\b"), 10) + _if(text.rlike(r"(?i)\balternative\b|\binstead\b"), 10) + _if(text.rlike(r"(?i)\bedge case\b|\bcorner case\b"), 10))


def overall(scores: dict[str, Column]) -> Column:
    """The weighted sum, in whole hundredths so that no rounding of binary fractions matters."""
    total = F.lit(0)
    for name, weight in P.WEIGHTS.items():
        total = total + scores[name] * weight
    return F.floor(total / 100).cast("int")


def grade(score: Column) -> Column:
    out = F.lit("F")
    for bound, name in reversed(P.GRADES):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def legacy(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), ((score - 1) * 12.5).cast("int")))


def percentiles(df: DataFrame, score: str) -> DataFrame:
    """df with percentile: the first rank of an equal score over the number of rows, in hundredths.

    Scores are few, rows are many: ranks come from a count a score, joined back.
    """
    counts = materialize(df.groupBy(score).agg(F.count("*").alias("_n")), "counts")
    # in two levels: sums inside ranges of scores, then over the ranges, of which there are few
    parts = counts.repartitionByRange(score).select("*", F.spark_partition_id().alias("_part"))
    parts = materialize(parts, "ranges")
    before = parts.groupBy("_part").agg(F.sum("_n").alias("_sum")).select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    upto = W.partitionBy("_part").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranks = parts.withColumn("_rank", F.coalesce(F.sum("_n").over(upto), F.lit(0)) + 1).join(F.broadcast(before), "_part")
    ranks = ranks.select(F.col(score).alias("_s"), (100 * (F.col("_rank") + F.col("_before")) / F.col("_all")).alias("percentile"))
    ranks = F.broadcast(ranks) if small_enough(counts, 200_000) else ranks
    return df.join(ranks, F.col(score).eqNullSafe(F.col("_s"))).drop("_s")


def verdict(scores: dict[str, Column]) -> Column:
    """A sentence from the dimensions: up to two strengths (75 and more) and two gaps (40 and less)."""
    names = lambda cond: F.array_join(F.slice(F.filter(F.array(*[F.when(cond(c), F.lit(n.replace("_", " "))) for n, c in scores.items()]), lambda x: x.isNotNull()), 1, 2), " and ")
    strong, weak = names(lambda c: c >= 75), names(lambda c: c <= 40)
    said = F.concat_ws("; ", F.when(strong != "", F.concat(F.lit("strong in "), strong)), F.when(weak != "", F.concat(F.lit("weak in "), weak)))
    return F.when(said == "", "balanced").otherwise(said)


def term_frequency(rows: DataFrame, id_col: str, terms: str) -> DataFrame:
    """(term, rows): in how many rows each term occurs."""
    return rows.select(id_col, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("rows"))


def score_all(rows: DataFrame, text: str = "text", turns: str | None = None, summary: str | None = None) -> DataFrame:
    """rows with the five dimensions, overall, grade and percentile. Rare terms are those in at most two rows."""
    t = F.col(text)
    # numbers tell rows apart, also those that are alike; they are written, so they stay
    df = materialize(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_terms", T.terms(t)), "terms")
    seen = df.select("_id", F.explode("_terms").alias("term"))
    rare = seen.groupBy("term").agg(F.count("*").alias("n")).filter("n <= 2").select("term")
    per = seen.join(rare, "term", "left_semi").groupBy("_id").agg(F.count("*").alias("_rare"))
    df = df.join(per, "_id", "left")
    dims = {
        "technical_depth": technical_depth(t, F.col("_terms")), "practical_value": practical_value(t), "completeness": completeness(t, F.col(turns) if turns else T.turns_marked(t), F.col(summary).isNotNull() if summary else F.lit(False)),
        "clarity": clarity(t), "uniqueness": uniqueness(t, F.coalesce("_rare", F.lit(0))),
    }
    df = df.withColumns(dims).drop("_id", "_terms", "_rare")
    df = materialize(df.withColumn("overall", overall({k: F.col(k) for k in dims})), "scores")
    return percentiles(df.withColumn("grade", grade(F.col("overall"))), "overall")
