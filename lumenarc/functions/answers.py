"""What model answers, artifacts and changes are read as: columns only, no model is called."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as T



def stripped(text: Column) -> Column:
    """text without any white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_in(text: Column) -> Column:
    """The first part of a text that is JSON: the whole of it, a fenced block, or from the first brace to the last."""
    whole, fenced = text, F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    ok = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(whole), ok(fenced), ok(braces))


def field(text: Column, name: str) -> Column:
    """What follows the last line that begins with `NAME:`; null without one."""
    found = T.all_matches(text, rf"(?m)^[ \t]*{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def listed(value: Column, most: int) -> Column:
    """The parts of a list with commas, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(parts, 1, most)


def tags_answer(text: Column, most_tags: int = 15, most_topics: int = 7, most_subtopics: int = 5) -> list[Column]:
    """primary_domain, tags (of 2 to 49 characters), key_topics and subtopics of an answer in lines."""
    tags = F.filter(listed(field(text, "TAGS"), 10_000), lambda t: (F.char_length(t) > 1) & (F.char_length(t) < 50))
    return [
        F.coalesce(field(text, "DOMAIN"), F.lit("Uncategorized")).alias("primary_domain"), F.slice(tags, 1, most_tags).alias("tags"),
        listed(field(text, "TOPICS"), most_topics).alias("key_topics"), listed(field(text, "SUBTOPICS"), most_subtopics).alias("subtopics"),
    ]


def score_answer(text: Column, scale: int = 10) -> list[Column]:
    """score (5 without a number, at most scale) and reasoning (else the head of the answer)."""
    n = F.regexp_extract(F.coalesce(field(text, "SCORE"), F.lit("")), r"(\d+)", 1).try_cast("int")
    return [F.least(F.coalesce(n, F.lit(5)), F.lit(scale)).alias("score"), F.coalesce(F.nullif(field(text, "REASONING"), F.lit("")), F.substring(text, 1, 200)).alias("reasoning")]


def summary_answer(text: Column, target: int = 200) -> list[Column]:
    """abstractive and extractive; an answer without both labels is abstractive as a whole."""
    both = F.contains(text, F.lit("ABSTRACTIVE:")) & F.contains(text, F.lit("EXTRACTIVE:"))
    halves = F.split(text, "EXTRACTIVE:")
    first = stripped(F.replace(halves[0], F.lit("ABSTRACTIVE:"), F.lit("")))
    return [F.substring(F.when(both, first).otherwise(stripped(text)), 1, target + 50).alias("abstractive"), F.substring(F.when(both, stripped(F.get(halves, F.lit(1)))).otherwise(F.substring(text, 1, 500)), 1, 1000).alias("extractive")]


def insights_answer(text: Column, most: int = 5) -> list[Column]:
    """key_insights (the bullets under INSIGHTS), status, value_proposition and next_steps."""
    part = lambda name: stripped(F.regexp_replace(F.regexp_extract(text, rf"(?s)(?:^|\n)[ \t]*{name}:(.*?)(?=\n[ \t]*(?:INSIGHTS|STATUS|FUTURE VALUE|NEXT STEPS):|\n[ \t]*[-•]|$)", 1), r"\s*\n\s*", " "))
    block = F.regexp_extract(text, r"(?s)(?:^|\n)[ \t]*INSIGHTS:(.*?)(?=\n[ \t]*(?:STATUS|FUTURE VALUE|NEXT STEPS):|$)", 1)
    bullets = F.filter(T.all_matches(block, r"(?m)^[ \t]*[-•]+[-•]*[ \t]*(.*?)[ \t]*$", 1), lambda x: x != "")
    return [F.slice(bullets, 1, most).alias("key_insights"), F.coalesce(field(text, "STATUS"), F.lit("Completed")).alias("status"), part("FUTURE VALUE").alias("value_proposition"), part("NEXT STEPS").alias("next_steps")]


def clean_tag(tag: Column) -> Column:
    """A tag without the quotes and brackets that an answer puts round it; null if it has less than 3 characters."""
    bare = F.trim(F.regexp_replace(F.trim(tag), r"^[\"'\[\]]+|[\"'\[\]]+$", ""))
    return F.when(F.char_length(bare) > 2, bare)


def clean_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), clean_tag), lambda x: x.isNotNull())


def clean_title(text: Column) -> Column:
    """A title without space or quotes round it."""
    return F.regexp_replace(F.trim(text), r"^[\"']+|[\"']+$", "")


def change(old: Column, new: Column, lists: bool = False) -> Column:
    """added, removed, modified, added_items or removed_items; null where nothing changed."""
    empty = lambda c: c.isNull() | ((F.size(c) == 0) if lists else (c.cast("string") == ""))
    kind = F.when(empty(old) & empty(new), None).when(empty(old), "added").when(empty(new), "removed")
    if lists:
        more, less = F.size(F.array_except(new, old)) > 0, F.size(F.array_except(old, new)) > 0
        kind = kind.when(more & less, "modified").when(more, "added_items").when(less, "removed_items")
    return F.when(~old.eqNullSafe(new), kind.otherwise("modified"))


def diff(fields: dict[str, tuple[Column, Column, bool]]) -> Column:
    """The fields that changed, as an array of (field, change, old, new); values are JSON or text."""
    show = lambda c, lists: F.to_json(c) if lists else c.cast("string")
    rows = [F.when(change(a, b, x).isNotNull(), F.struct(F.lit(n).alias("field"), change(a, b, x).alias("change"), show(a, x).alias("old"), show(b, x).alias("new"))) for n, (a, b, x) in fields.items()]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


#: What an artifact is, by the language of its block.
ARTIFACT_TYPES = {"bash": "shell_command", "sh": "shell_command", "shell": "shell_command", "zsh": "shell_command", "sql": "sql_query", "json": "configuration", "yaml": "configuration", "yml": "configuration", "toml": "configuration", "ini": "configuration"}


def artifacts(text: Column, least: int = 20) -> Column:
    """The fenced blocks of a text of so many characters, each content once, as an array of (type, language, content)."""
    kinds = F.create_map(*[F.lit(x) for kv in ARTIFACT_TYPES.items() for x in kv])
    langs, blocks = T.all_matches(text, r"```(\w*)\n([\s\S]*?)```", 1), T.all_matches(text, r"```(\w*)\n([\s\S]*?)```", 2)
    made = F.zip_with(langs, blocks, lambda a, b: F.struct(F.coalesce(kinds[a], F.lit("code_snippet")).alias("type"), F.when(a == "", "unknown").otherwise(a).alias("language"), stripped(b).alias("content")))
    long = F.filter(made, lambda x: F.char_length(x["content"]) >= least)
    contents = F.transform(long, lambda x: x["content"])
    return F.filter(long, lambda x, i: F.array_position(contents, x["content"]) == i + 1)


def size_label(n: Column) -> Column:
    tenths = lambda x: F.bround(x.cast("double"), 1)  # a tie goes to the even digit
    out = F.format_string("%.1f TB", tenths(n / 1024.0**4))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", tenths(n / 1024.0**k))).otherwise(out)
    return out


def duration_label(seconds: Column) -> Column:
    whole = lambda c: F.floor(c).cast("long")
    minutes = F.format_string("%dm %ds", whole(seconds / 60), whole(seconds % 60))
    return F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1))).when(seconds < 3600, minutes).otherwise(F.format_string("%dh %dm", whole(seconds / 3600), whole(seconds % 3600 / 60)))


def ago_label(ts: Column, now: Column) -> Column:
    s = F.unix_seconds(now) - F.unix_seconds(ts)
    say = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "Never").when(s >= 86400, say(86400, "d")).when(s >= 3600, say(3600, "h")).when(s >= 60, say(60, "m")).otherwise("Just now")


def masked_secret(value: Column, shown: int = 4) -> Column:
    """A secret with its last characters alone; short ones are hidden whole."""
    return F.when(F.char_length(value) > 2 * shown, F.concat(F.lit("****"), F.right(value, F.lit(shown)))).when(value.isNotNull(), "****")
