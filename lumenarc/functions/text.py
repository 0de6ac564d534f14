"""Text features as columns: no Python runs on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import patterns as P


def any_of(text: Column, regexes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text.rlike(r), F.lit(False)) for r in regexes])


def how_many(text: Column, regexes: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [F.coalesce(text.rlike(r), F.lit(False)).cast("int") for r in regexes])


def which(text: Column, named: dict[str, str]) -> Column:
    """The names of the patterns that occur, in their order."""
    return F.filter(F.array(*[F.when(text.rlike(r), F.lit(n)) for n, r in named.items()]), lambda x: x.isNotNull())


def all_matches(text: Column, regex: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(regex if group else f"({regex})"), F.lit(group or 1)), F.array().cast("array<string>"))


def code_blocks(text: Column) -> Column:
    return all_matches(text, P.CODE_BLOCK, 2)


def code_languages(text: Column) -> Column:
    return language_names(all_matches(text, P.CODE_BLOCK, 1))


def language_names(found: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in P.LANGUAGE_ALIASES.items() for x in kv])
    names = F.filter(F.transform(found, F.lower), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(names, lambda x: F.coalesce(alias[x], x))))


def urls(text: Column, most: int = 20) -> Column:
    return F.slice(all_matches(text, f"(?i){P.URL}"), 1, most)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1), r":\d+$", "")


def link_domains(text: Column) -> Column:
    return domains_of(urls(text))


def domains_of(found: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, host))), 1, 10)


def files(text: Column) -> Column:
    found = F.flatten(F.array(*[all_matches(text, r) for r in P.FILES]))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.startswith("//")))), 1, 20)


def question_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("?")))


def term_matches(text: Column) -> Column:
    """Every technical term of a text: single words by equality of tokens, the others by one pattern."""
    low = F.lower(text)
    single, others = [t for t in P.TERMS if t.isalnum()], [t for t in P.TERMS if not t.isalnum()]
    words = F.filter(all_matches(low, r"[\p{L}\p{N}_]+"), lambda w: w.isin(single))
    return F.concat(words, all_matches(low, r"\b(?:" + "|".join(others) + r")\b"))


def ranked_terms(found: Column) -> Column:
    """Terms by falling count, then by name; 30 at most. There are no more than the list has."""
    counted = F.transform(F.array_distinct(found), lambda t: F.struct((-F.size(F.filter(found, lambda x: x == t))).alias("n"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(counted), lambda x: x["t"]), 1, 30)


def terms(text: Column) -> Column:
    """Technical terms by falling count, then by name; 30 at most."""
    return ranked_terms(term_matches(text))


def turns_marked(text: Column) -> Column:
    return F.least(F.regexp_count(text, F.lit(r"(?im)^(?:USER|Human|You):")), F.regexp_count(text, F.lit(r"(?im)^(?:ASSISTANT|Claude|ChatGPT|Gemini|AI):")))


def features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and all columns of the model-free feature extraction; what several columns need is found once."""
    t = F.col(text)
    parts = {"_blocks": code_blocks(t), "_names": all_matches(t, P.CODE_BLOCK, 1), "_urls": urls(t), "_terms": term_matches(t)}
    rows = df.select(*keep, t.alias("_text"), *[c.alias(n) for n, c in parts.items()])
    t = F.col("_text")
    return rows.select(
        *keep, (F.size("_blocks") > 0).alias("has_code"), language_names(F.col("_names")).alias("code_languages"), F.size("_blocks").alias("code_block_count"), any_of(t, P.ERRORS).alias("has_error_traces"),
        (F.size("_urls") > 0).alias("has_links"), domains_of(F.col("_urls")).alias("link_domains"), F.col("_urls").alias("link_urls"), question_count(t).alias("question_count"), which(t, P.QUESTIONS).alias("question_types"),
        ranked_terms(F.col("_terms")).alias("technical_terms"), files(t).alias("mentioned_files"), turns_marked(t).alias("turn_count"),
    )


def title(text: Column) -> Column:
    return F.when(F.char_length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)


def preview(text: Column, most: int = 60) -> Column:
    first = F.trim(F.split(F.trim(text), "\n")[0])
    return F.when(F.char_length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)


def middle_cut(text: Column, most: int, mark: str = "\n...\n") -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most // 2), F.lit(mark), F.right(text, F.lit(most // 2))))


def html_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")


def when_said(text: Column) -> Column:
    """A timestamp from any of the formats that exports use; null if it is none of them."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy, h:mm:ss a"]
    epoch = F.when(text.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(text.try_cast("double")))
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def week_label(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def source_name(source: Column) -> Column:
    low = F.lower(source)
    return F.when(low.isin("chatgpt", "openai"), "OpenAI").when(low.isin("claude", "anthropic"), "Anthropic").when(low.isin("gemini", "google"), "Google").otherwise(source)


def role_name(role: Column, unknown: str | None = "user") -> Column:
    low = F.lower(role)
    other = F.lit(unknown) if unknown else F.lit(None).cast("string")
    return F.when(low.isin("user", "human"), "user").when(low.isin("assistant", "model", "ai", "bot"), "assistant").when(low == "system", "system").otherwise(other)


def score_value(score: Column) -> Column:
    return F.coalesce(F.bround(score.cast("double")).cast("int"), F.lit(5))


def content_hash(source: Column, title_: Column, first: Column, last: Column, at: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source, title_, first, last, at)]), 256)


def raw_text(title_: Column, messages: Column) -> Column:
    """A title line and each turn under its role, from array<struct<role, text>>."""
    return F.concat(title_, F.lit("\n\n"), F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["text"], F.lit("\n"))), "\n"))
