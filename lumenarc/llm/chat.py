"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags a segment. All native.

The template names the markers around a turn of each role and whether the text counts for the loss. Texts are escaped
reversibly: a backslash is doubled, and every control string gets a backslash after its first character, so no marker
can arise inside a text. Reading back finds the markers, undoes the escapes and gives the very turns that went in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: The markers before and after a turn, by role, and whether its text is under the loss mask. The role "*"
#: stands for every other role, whose (escaped) name stands between its opening marker and a bar.
TEMPLATE = {
    "system": {"before": "<<SYS>> ", "after": " <</SYS>>", "loss": False},
    "user": {"before": "[INST] ", "after": " [/INST]", "loss": False},
    "assistant": {"before": "<s> ", "after": " </s>", "loss": True},
    "*": {"before": "[TURN] ", "after": " [/TURN]", "loss": False},
}
#: The control strings that a text may not hold unescaped.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]"]
#: The machine: state by state, the role that may come next and the state that it leads to. It may stop in "answered".
MACHINE = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
FINAL = {"answered"}


def _quote(s: str) -> str:
    return re.sub(r"([\\\[\]().*+?{}^$|/<>-])", r"\\\1", s)


def escape(text: Column) -> Column:
    """text without unescaped control strings."""
    doubled = F.regexp_replace(text, F.lit(r"\\"), F.lit(r"\\\\"))
    inner = "|".join(f"(?<={_quote(c[0])}){_quote(c[1:])}" for c in sorted(CONTROLS, key=len, reverse=True))
    return F.regexp_replace(doubled, F.lit(f"({inner})"), F.lit(r"\\$1"))


def _escape_name(name: Column) -> Column:
    """A role's name without a bar: a bar becomes a backslash and the letter p, which no other escape makes."""
    return F.replace(escape(name), F.lit("|"), F.lit(r"\p"))


def _unescape_name(name: Column) -> Column:
    return unescape(F.regexp_replace(name, F.lit(r"(?<!\\)((?:\\\\)*)\\p"), F.lit("$1|")))


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _final_state(roles: Column) -> Column:
    def step(state: Column, role: Column) -> Column:
        out = F.lit("invalid")
        for at, moves in MACHINE.items():
            for said, to in moves.items():
                out = F.when((state == at) & (role == said), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step)


def _segments(turns: Column) -> Column:
    """array<struct<text, loss>> of all turns; the texts in order make up the formatted conversation."""

    def parts(t: Column) -> Column:
        body = escape(t["text"])
        piece = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        other = TEMPLATE["*"]
        out = F.array(piece(F.concat(F.lit(other["before"]), _escape_name(t["role"]), F.lit("|")), False), piece(body, other["loss"]), piece(F.lit(other["after"]), False))
        for role, m in TEMPLATE.items():
            if role != "*":
                out = F.when(t["role"] == role, F.array(piece(F.lit(m["before"]), False), piece(body, m["loss"]), piece(F.lit(m["after"]), False))).otherwise(out)
        return out

    return F.flatten(F.transform(turns, parts))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, state, valid, segments, formatted): one row a conversation.

    Turns go in the order of turn; ties go by role and text, a null turn comes first, repeated rows stay. A null text or
    role counts as empty. valid says that the turn order is one that MACHINE accepts; conversations that it rejects are
    formatted all the same. Rows with a null conv_id make one conversation. An empty table gives no row; other columns
    are not read. A conversation is one output value, so it has to fit in a task.
    """
    rows = messages.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    done = chats.select("conv_id", _final_state(F.transform("turns", lambda t: t["role"])).alias("state"), _segments(F.col("turns")).alias("segments"))
    return done.select("conv_id", "state", F.col("state").isin(*FINAL).alias("valid"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    marks = [(role, m["before"], m["after"]) for role, m in TEMPLATE.items()]
    one = "|".join(f"{_quote(a)}(?:.*?){_quote(b)}" for _, a, b in marks)

    def turn(x: Column) -> Column:
        out = F.lit(None).cast("struct<role:string,text:string>")
        for role, a, b in marks:
            body = F.substr(x, F.lit(len(a) + 1), F.char_length(x) - F.lit(len(a) + len(b)))
            if role == "*":
                bar = F.locate("|", body)  # _escape_name leaves no bar inside a name
                made = F.struct(_unescape_name(F.substr(body, F.lit(1), bar - 1)).alias("role"), unescape(F.substr(body, bar + 1)).alias("text"))
            else:
                made = F.struct(F.lit(role).alias("role"), unescape(body).alias("text"))
            out = F.when(F.startswith(x, F.lit(a)), made).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s)({one})"), F.lit(1)), turn)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The digests of op5's contract, from what format_chats() put out: turns are read back from the formatted text."""
    read = formatted.select("conv_id", "state", "valid", "segments", "formatted", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"), "state", "valid")
    return out.select("conv_id", "n_turns", F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "state", "valid")
