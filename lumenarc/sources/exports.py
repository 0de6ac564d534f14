"""Readers of chat exports: tree JSON, linear JSON and JSON lines, two kinds of HTML, and the engine's own JSON lines.

Each gives conversations: source, external_id, title, created_at, messages (array of struct role, text, created_at).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

MESSAGE = "struct<id:string,uuid:string,text:string,content:string,sender:string,role:string,created_at:string,timestamp:string>"
LINEAR = f"uuid string, id string, conversation_id string, chat_id string, name string, title string, created_at string, timestamp string, date string, create_time string, chat_messages array<{MESSAGE}>, messages array<{MESSAGE}>"
NODE = "struct<id:string,parent:string,children:array<string>,message:struct<id:string,author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>"
TREE = f"id string, conversation_id string, title string, create_time string, update_time string, mapping map<string,{NODE}>"


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line fails the read, or is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, or one object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _first(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def linear(df: DataFrame, source: str, unknown_role: str | None = "user") -> DataFrame:
    """Exports with a list of messages, whatever their fields are called."""
    said = F.coalesce("chat_messages", "messages", F.array().cast(f"array<{MESSAGE}>"))
    made = F.transform(said, lambda m: F.struct(T.role_name(F.coalesce(m["sender"], m["role"]), unknown_role).alias("role"), F.trim(F.coalesce(m["text"], m["content"])).alias("text"), T.when_said(F.coalesce(m["created_at"], m["timestamp"])).alias("created_at")))
    kept = F.filter(made, lambda m: m["role"].isNotNull() & (F.coalesce(m["text"], F.lit("")) != ""))
    return df.select(F.lit(source).alias("source"), _first("uuid", "id", "conversation_id", "chat_id").alias("external_id"), T.title(F.coalesce(_first("name", "title"), F.lit("Untitled"))).alias("title"), T.when_said(_first("created_at", "timestamp", "date", "create_time")).alias("created_at"), kept.alias("messages"))


def tree(df: DataFrame, source: str = "OpenAI", unknown_role: str | None = "user") -> DataFrame:
    """Exports with a tree of nodes: from the first root along first children. Conversations without a node are dropped.

    The walk doubles its stride each round, so a chat of n messages takes log2(n) joins.
    """
    rows = df.filter(F.size("mapping") > 0).withColumn("external_id", _first("id", "conversation_id"))
    nodes = rows.select("external_id", F.posexplode(F.map_entries("mapping")).alias("at", "e"))
    nodes = nodes.select("external_id", "at", F.col("e.key").alias("node"), F.col("e.value.parent").alias("parent"), F.get("e.value.children", F.lit(0)).alias("next"), F.col("e.value.message").alias("m"))
    known = nodes.select("external_id", F.col("node").alias("parent")).withColumn("k", F.lit(True))
    roots = nodes.join(known, ["external_id", "parent"], "left").filter("k is null").groupBy("external_id").agg(F.min_by("node", "at").alias("root"))
    # place: distance from a node to the end of its first-child chain
    ahead = nodes.select("external_id", "node", F.col("next").alias("to"), F.when(F.col("next").isNotNull(), 1).otherwise(0).alias("d"))
    reach = roots.select("external_id", F.col("root").alias("node"), F.lit(0).alias("depth"))
    longest = nodes.groupBy("external_id").count().agg(F.max("count")).first()[0] or 0
    stride = 1
    while stride < longest:
        reach = reach.union(reach.join(ahead.filter("to is not null"), ["external_id", "node"]).select("external_id", F.col("to").alias("node"), (F.col("depth") + F.col("d")).alias("depth")))
        step = ahead.select("external_id", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        ahead = ahead.join(step, ["external_id", "to"]).filter("to2 is not null").select("external_id", "node", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"))
        stride *= 2
    role = T.role_name(F.col("m.author.role"), unknown_role)
    body = F.trim(F.array_join(F.filter("m.content.parts", lambda p: F.coalesce(p, F.lit("")) != ""), "\n"))
    said = nodes.join(reach, ["external_id", "node"]).filter(F.col("m").isNotNull()).select("external_id", "depth", role.alias("role"), body.alias("text"), F.timestamp_seconds("m.create_time").alias("created_at"))
    said = said.filter("role is not null and role <> 'system' and text <> ''")
    chats = said.groupBy("external_id").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text", "created_at"))).alias("s"))
    chats = chats.select("external_id", F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["created_at"].alias("created_at"))).alias("messages"))
    heads = rows.select(F.lit(source).alias("source"), "external_id", T.title(F.coalesce(_first("title"), F.lit("Untitled"))).alias("title"), T.when_said(F.col("create_time")).alias("created_at"))
    return heads.join(chats, "external_id").select("source", "external_id", "title", "created_at", "messages")


def takeout(df: DataFrame, html: str = "value", source: str = "Google") -> DataFrame:
    """Activity pages: one conversation a block of prompt, time and response."""
    blocks = df.select(F.posexplode(F.split(html, r'<div class="outer-cell[^"]*">')).alias("no", "b")).filter("no > 0")
    prompt = T.html_text(F.regexp_extract("b", r"(?s)Prompted\s*(?:&nbsp;| |\s)*(.*?)<br", 1))
    when = F.regexp_extract("b", r"([A-Z][a-z]{2} \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2}\s*[AP]M)", 1)
    answer = T.html_text(F.regexp_extract("b", r"(?s)[AP]M [A-Z]+<br>(.*?)</div>", 1))
    at = T.when_said(F.regexp_replace(when, r"[  ]", " "))
    said = F.filter(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("text"), at.alias("created_at")), F.struct(F.lit("assistant").alias("role"), answer.alias("text"), at.alias("created_at"))), lambda m: m["text"] != "")
    return blocks.select(F.lit(source).alias("source"), F.concat(T.slug(F.substring(prompt, 1, 30)), F.lit("-"), F.col("no").cast("string")).alias("external_id"), T.title(prompt).alias("title"), at.alias("created_at"), said.alias("messages")).filter(F.size("messages") > 0)


def simple_html(df: DataFrame, html: str = "value", source: str = "Google") -> DataFrame:
    """Pages of labelled turns; without labels, paragraphs of over 10 characters alternate."""
    you = T.all_matches(F.col(html), r"(?s)You:\s*</[^>]+>(.*?)(?=<(?:b|strong|h\d)[^>]*>\s*(?:You|Gemini):|$)", 1)
    them = T.all_matches(F.col(html), r"(?s)Gemini:\s*</[^>]+>(.*?)(?=<(?:b|strong|h\d)[^>]*>\s*(?:You|Gemini):|$)", 1)
    never = F.lit(None).cast("timestamp").alias("created_at")
    turn = lambda role, t: F.struct(F.lit(role).alias("role"), T.html_text(t).alias("text"), never)
    labelled = F.flatten(F.transform(F.arrays_zip(you.alias("y"), them.alias("g")), lambda z: F.array(turn("user", z["y"]), turn("assistant", z["g"]))))
    paragraphs = F.filter(F.transform(T.all_matches(F.col(html), r"(?s)<p[^>]*>(.*?)</p>", 1), T.html_text), lambda t: F.char_length(t) > 10)
    plain = F.transform(paragraphs, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("text"), never))
    said = F.filter(F.when(F.size(you) > 0, labelled).otherwise(plain), lambda m: F.coalesce(m["text"], F.lit("")) != "")
    return df.select(F.lit(source).alias("source"), F.sha2(html, 256).alias("external_id"), F.coalesce(F.nullif(T.html_text(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.lit("")), F.lit("Untitled")).alias("title"), F.lit(None).cast("timestamp").alias("created_at"), said.alias("messages"))


#: Which reader takes a document: in order, the fields that one must have.
FORMATS: dict[str, Callable[[set[str]], bool]] = {
    "tree": lambda f: "mapping" in f,
    "linear": lambda f: bool(f & {"chat_messages", "messages"}),
}


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file, from its first characters and the fields of its first object."""
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 1 << 16)).first()[0].lstrip()
    if head.startswith("<"):
        return "takeout" if "outer-cell" in head else "html"
    body = head.lstrip("[ \n\r\t")
    try:
        fields = set(json.JSONDecoder().raw_decode(body)[0])
    except ValueError:
        fields = {k for k in ("mapping", "chat_messages", "messages") if f'"{k}"' in body}
    return next((n for n, ok in FORMATS.items() if ok(fields)), "unknown")


def by_lines(spark: SparkSession, path: str) -> bool:
    """True if a file holds one JSON object a line, rather than one document."""
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 1 << 16)).first()[0].lstrip()
    if not head.startswith("{"):
        return False
    line, more, _ = head.partition("\n")
    try:
        json.loads(line)
    except ValueError:
        return not more  # a first line that goes on beyond the head is one whole object
    return True


def read_export(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Any export, by what it is found to be."""
    kind = sniff(spark, path)
    if kind in ("tree", "linear"):
        read = read_lines if by_lines(spark, path) else read_document
        return tree(read(spark, path, TREE), source_label(source)) if kind == "tree" else linear(read(spark, path, LINEAR), source_label(source))
    if kind == "takeout":
        return takeout(spark.read.text(path, wholetext=True), source=source_label(source))
    if kind == "html":
        return simple_html(spark.read.text(path, wholetext=True), source=source_label(source))
    raise ValueError(f"{path} is no known export")


def source_label(name: str) -> str:
    known = {"chatgpt": "OpenAI", "openai": "OpenAI", "claude": "Anthropic", "anthropic": "Anthropic", "gemini": "Google", "google": "Google"}
    return known.get(name.lower(), name)
