"""Personal data: counts a type natively, resolved spans and scrubbing in one Arrow pass."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import plain
from . import patterns as P


def counts(text: Column, types: list[str] | None = None) -> list[Column]:
    """Candidates of each type; spans that overlap count for each."""
    return [F.coalesce(F.regexp_count(text, F.lit(r)), F.lit(0)).alias(n) for n, r, _, _ in P.PII if n in (types or P.PII_DEFAULT)]


def has_pii(text: Column, types: list[str] | None = None) -> Column:
    out = F.lit(False)
    for n, r, _, _ in P.PII:
        if n in (types or P.PII_DEFAULT):
            out = out | F.coalesce(text.rlike(r), F.lit(False))
    return out


def redact_one(text: Column, kind: str) -> Column:
    """text with every candidate of one type replaced, natively."""
    regex = next(r for n, r, _, _ in P.PII if n == kind)
    return F.regexp_replace(text, F.lit(regex), F.lit(f"[REDACTED-{kind.upper().replace('_', '-')}]"))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    if kind == "credit_card":
        return len(digits) >= 13 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip_address":
        return not value.startswith(tuple(P.PRIVATE_IP))
    return True


def find(text: str, types: list[str], allowed: frozenset[str] = frozenset(), least: int = 0, custom: dict[str, str] | None = None) -> list[tuple[str, int, int, str, int, float]]:
    """(type, start, end, value, severity, confidence), none overlapping: the more severe and surer ones come first."""
    found = []
    for n, r, severity, sure in [*P.PII, *((k, v, 2, 0.8) for k, v in (custom or {}).items())]:
        if (n in types or n in (custom or {})) and severity >= least:
            found += [(n, m.start(), m.end(), m[0], severity, sure) for m in re.finditer(r, text) if m[0] not in allowed and _valid(n, m[0])]
    kept: list = []
    for x in sorted(found, key=lambda x: (-x[4], -x[5])):
        if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[1])


def _mask(kind: str, v: str) -> str:
    """v with little left to see: of short names and values nothing."""
    digits = re.sub(r"\D", "", v)
    if kind == "email" and v.count("@") == 1:
        name, _, domain = v.partition("@")
        return (name[:2] if len(name) > 2 else "").ljust(len(name), "*") + "@" + domain
    if kind == "ssn":
        return "***-**-" + v[-4:]
    if kind == "ip_address":
        return v.partition(".")[0] + ".***.***.*"
    if kind in ("credit_card", "phone") and len(digits) >= 4:
        return digits[-4:].rjust(len(digits), "*")
    return v[:2] + "*" * (len(v) - 4) + v[-2:] if len(v) > 4 else "*" * len(v)


MODES = {
    "redact": lambda k, v: f"[REDACTED-{k.upper().replace('_', '-')}]",
    "hash": lambda k, v: f"[{k.upper()}-{hashlib.sha256(v.encode()).hexdigest()[:12]}]",
    "mask": _mask,
    "remove": lambda k, v: "",
    "tokenize": lambda k, v: f"[{k.upper()}-{hashlib.md5(v.encode()).hexdigest()[:8]}]",
}


def scrub(df: DataFrame, text: str = "text", mode: str = "redact", types: list[str] | None = None, allowed: tuple[str, ...] = (), least: int = 0, custom: dict[str, str] | None = None, context: int = 20) -> DataFrame:
    """df with scrubbed and matches (array of type, start, end, value, context, severity, confidence, token)."""
    use, ok = types or P.PII_DEFAULT, frozenset(allowed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out, spans = [], []
            for t in x[text]:
                found = find(t or "", use, ok, least, custom)
                spans.append([{"type": k, "start": a, "end": b, "value": v, "context": t[max(0, a - context) : b + context], "severity": s, "confidence": c, "token": MODES[mode](k, v)} for k, a, b, v, s, c in found])
                for k, a, b, v, _, _ in reversed(found):
                    t = t[:a] + MODES[mode](k, v) + t[b:]
                out.append(t)
            yield plain(x.assign(scrubbed=out, matches=spans))

    kind = "array<struct<type:string,start:int,end:int,value:string,context:string,severity:int,confidence:double,token:string>>"
    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", scrubbed string, matches {kind}")


def vault(scrubbed: DataFrame) -> DataFrame:
    """(token, type, value): what each emitted token stands for."""
    return scrubbed.select(F.explode("matches").alias("m")).select("m.token", "m.type", "m.value").distinct()


def types_found(text: Column, types: list[str] | None = None) -> Column:
    """The names of the types that text has candidates of, in the order of the list."""
    return F.filter(F.array(*[F.when(text.rlike(r), F.lit(n)) for n, r, _, _ in P.PII if n in (types or P.PII_DEFAULT)]), lambda x: x.isNotNull())


def route(text: Column, types: list[str] | None = None) -> Column:
    """Where a text may be enriched: `local` if it has personal data, else `remote`."""
    return F.when(has_pii(text, types), "local").otherwise("remote")


def forget(kept: DataFrame, tokens: DataFrame) -> DataFrame:
    """A vault without some tokens."""
    return kept.join(tokens.select("token").distinct(), "token", "left_anti")


def audit(scrubbed: DataFrame) -> DataFrame:
    return scrubbed.select(F.explode("matches").alias("m")).groupBy("m.type", "m.severity").agg(F.count("*").alias("n"))
