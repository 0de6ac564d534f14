"""Topic segments of conversations: boundaries between turns, gaps and islands, short segments merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P, text as T


def _apart(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (shared < 0.2)


def boundaries(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    w = W.partitionBy(conv).orderBy(turn)
    rows = turns.withColumn("techs", T.which(F.lower(text), P.TECHS)).withColumn("concepts", T.which(F.lower(text), P.CONCEPTS))
    shift = _apart(F.lag("techs").over(w), F.col("techs")) | _apart(F.lag("concepts").over(w), F.col("concepts"))
    new = (F.row_number().over(w) > 1) & (T.any_of(F.col(text), P.TOPIC_CHANGES) | F.coalesce(shift, F.lit(False)))
    return rows.withColumn("boundary", new)


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", least: int = 100) -> DataFrame:
    """(conv, segment, first_turn, last_turn, n_turns, n_chars): a short segment joins the one before it."""
    w = W.partitionBy(conv).orderBy(turn)
    rows = boundaries(turns, conv, turn, text).withColumn("_s", F.sum(F.col("boundary").cast("int")).over(w))
    parts = rows.groupBy(conv, "_s").agg(F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count("*").alias("n_turns"), F.sum(F.char_length(text)).alias("n_chars"))
    v = W.partitionBy(conv).orderBy("_s")
    parts = parts.withColumn("segment", F.sum(((F.col("_s") == 0) | (F.col("n_chars") >= least)).cast("int")).over(v) - 1)
    return parts.groupBy(conv, "segment").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("n_chars"))


def turns_of(df: DataFrame, raw: str, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text): a text split before lines that begin with a role; the rest of a text has the role user."""
    parts = F.split(raw, r"\n(?=(?:Human|User|Assistant|Claude|AI):)")
    rows = df.select(conv, F.posexplode(parts).alias("turn", "part"))
    role = F.regexp_extract("part", r"^(Human|User|Assistant|Claude|AI):", 1)
    name = F.when(role.isin("Assistant", "Claude", "AI"), "assistant").otherwise("user")
    rows = rows.select(conv, "turn", name.alias("role"), F.trim(F.regexp_replace("part", r"^(?:Human|User|Assistant|Claude|AI):", "")).alias("text"))
    return rows.filter("text <> ''")


def topic(text: Column, techs: Column, concepts: Column) -> Column:
    """The name of a segment: its first technologies, else its first concept, else what kind of text it is."""
    first = lambda a, k: F.initcap(F.element_at(a, k))
    one, two = F.concat(first(techs, 1), F.lit(" Development")), F.concat(first(techs, 1), F.lit(" & "), F.initcap(F.get(techs, F.lit(1))))
    plain = F.when(F.contains(text, F.lit("?")), "Question & Answer").when(F.contains(text, F.lit("```")), "Code Implementation").otherwise("Discussion")
    return F.when(F.size(techs) == 1, one).when(F.size(techs) > 1, two).when(F.size(concepts) > 0, F.initcap(F.get(concepts, F.lit(0)))).otherwise(plain)


#: What a segment is also about.
SUBTOPICS = {
    "Troubleshooting": r"(?i)\berror\b|\bfix\b|\bissue\b", "Setup": r"(?i)\binstall\b|\bsetup\b|\bconfigure\b", "Tutorial": r"(?i)\bexample\b|\bhow to\b|\btutorial\b",
    "Optimization": r"(?i)\brefactor\b|\bimprove\b|\boptimize\b", "Explanation": r"(?i)\bexplain\b|\bunderstand\b|\bwhy\b",
}


def described(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", least: int = 100) -> DataFrame:
    """segments() with content, topic, subtopics, technologies, has_code, confidence and related, the segments that share a technology."""
    spans = segments(turns, conv, turn, text, least)
    rows = turns.join(spans.select(conv, "segment", "first_turn", "last_turn"), conv).filter(F.col(turn).between(F.col("first_turn"), F.col("last_turn")))
    whole = rows.groupBy(conv, "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    whole = whole.withColumns({"technologies": T.which(F.lower("content"), P.TECHS), "concepts": T.which(F.lower("content"), P.CONCEPTS)})
    out = whole.withColumns({
        "topic": topic(F.col("content"), F.col("technologies"), F.col("concepts")), "subtopics": F.slice(T.which(F.col("content"), SUBTOPICS), 1, 3), "has_code": F.contains("content", F.lit("```")),
        "confidence": F.when((F.size("technologies") > 0) | (F.size("concepts") > 0), 0.8).otherwise(0.5),
    })
    named = out.select(conv, "segment", F.explode("technologies").alias("_t"))
    near = named.join(named.select(conv, F.col("segment").alias("_o"), "_t"), [conv, "_t"]).filter(F.col("segment") != F.col("_o"))
    near = near.groupBy(conv, "segment").agg(F.array_sort(F.collect_set("_o")).alias("related"))
    return spans.join(out, [conv, "segment"]).join(near, [conv, "segment"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<bigint>")))


def topics(described_: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, topic_count, primary_topic, flow, summary): the topics of each conversation, in order."""
    weight = F.char_length("content") + 100 * F.size("technologies")
    flow = F.transform(F.sort_array(F.collect_list(F.struct("segment", "topic"))), lambda x: x["topic"])
    out = described_.groupBy(conv).agg(F.count("*").alias("topic_count"), F.max_by("topic", F.struct(weight, -F.col("segment"))).alias("primary_topic"), flow.alias("flow"))
    said = F.when(F.col("topic_count") == 1, F.concat(F.lit("Single topic: "), F.get("flow", F.lit(0)))).otherwise(F.concat(F.lit("Multi-topic conversation: "), F.array_join("flow", ", ")))
    return out.withColumn("summary", said)


def many_topics(found: DataFrame, k: int, conv: str = "conv_id") -> DataFrame:
    """The conversations with several topics, those with the most first."""
    return found.filter("topic_count > 1").orderBy(F.desc("topic_count"), conv).limit(k)
