"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased whole text, hashed to a fixed number of buckets. Document frequencies
come from all documents that may be learned from; the classifier is fitted on a bounded sample of them, by
follow-the-regularised-leader with elastic-net penalties, and calibrated by one temperature on a part of that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..workspace import by_size, materialize, plain, small_enough, unused

BUCKETS = 1 << 15
#: Rows that the classifier is fitted on, at most; shared out evenly among the languages.
SAMPLE_ROWS = 4000
#: Entries of their vectors, at most, six bytes each: the fit stops reading rows, in order of their hashes, beyond it.
SAMPLE_ENTRIES = 40_000_000
#: Odd multipliers that spread n-grams over the buckets.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UNKNOWN = "und"
#: Texts up to which those rejected, and those given a language, are broadcast.
BROADCAST_ROWS = 1_000_000


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket by language
    bias: np.ndarray
    temperature: float


def _buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    at, keys = points * np.uint32(MIX[0]), []
    for n in (1, 2, 3):
        if n > 1:
            at = (at[:-1] ^ np.uint32(n)) * np.uint32(MIX[1]) + points[n - 1 :] * np.uint32(MIX[2])
        keys.append((at ^ (at >> np.uint32(15))) * np.uint32(MIX[0]) >> np.uint32(17))
    counts = np.bincount(np.concatenate(keys), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = _buckets(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(1e-12, np.sqrt(np.dot(x, x)))


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows' texts each bucket occurs, and the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for x in by_size(batches, "text"):
            for t in x["text"]:
                df[_buckets(t)[0]] += 1
            n += len(x)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1).astype(np.int32), "n": np.append(df[at], n)})

    found = rows.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS, np.int64)
    own = found[found["bucket"] >= 0]
    df[own["bucket"].to_numpy()] = own["n"].to_numpy()
    return df, int(found.loc[found["bucket"] < 0, "n"].sum())


def _sample(rows: DataFrame) -> DataFrame:
    """(lang, h, text) of at most SAMPLE_ROWS rows: of each language the different texts with the smallest hashes."""
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit(5)).alias("h"))
    keys = materialize(rows.select("lang", "h").distinct(), "hashes")
    langs = materialize(keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS), "langs")
    each = max(1, SAMPLE_ROWS // max(1, langs.count()))
    # hashes are even over their range, so its lowest part holds about twice the wanted texts, however many there are
    low = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * each + 50
    keys = keys.join(F.broadcast(langs), "lang").filter(low)
    keys = keys.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= each).select("lang", "h")
    return rows.join(F.broadcast(keys), ["lang", "h"]).select("lang", "h", "text").dropDuplicates(["lang", "h"])


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket by class, many of them exactly zero) and bias, by follow-the-regularised-leader."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == BUCKETS, 0, l1)[:, None], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at.astype(np.int64), BUCKETS), np.append(x.astype(float), 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _fit(sample: list[tuple[np.ndarray, np.ndarray, str]], langs: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature; where there is enough, a fifth of the sample sets the temperature alone."""
    number = {v: k for k, v in enumerate(langs)}
    rows = [(at, x, number[lang]) for at, x, lang in sample]
    held = rows[::5] if len(rows) >= 50 else rows
    w, bias = _ftrl([s for k, s in enumerate(rows) if k % 5 or len(rows) < 50], len(langs))
    return w, bias, _temperature(np.array([x @ w[at] + bias for at, x, _ in held]), np.array([y for _, _, y in held]))


def train(rows: DataFrame) -> Model:
    """rows: lang and text, both non-null; only those that may be learned from."""
    rows = rows.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, total = _frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_size(batches, "text"):
            both = [_vector(t, idf) for t in x["text"]]
            yield plain(pd.DataFrame({"lang": x["lang"], "h": x["h"], "at": [a.astype(np.int16).tobytes() for a, _ in both], "x": [v.astype(np.float32).tobytes() for _, v in both]}))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, held = [], 0
        for x in batches:
            for lang, at, v in zip(x["lang"], x["at"], x["x"], strict=True):
                if held < SAMPLE_ENTRIES:
                    sample.append((np.frombuffer(at, np.int16), np.frombuffer(v, np.float32), lang))
                    held += len(sample[-1][0])
        langs = sorted({lang for _, _, lang in sample})
        if langs:
            w, bias, t = _fit(sample, langs)
            yield plain(pd.DataFrame({"lang": langs, "at": [np.flatnonzero(c).astype(np.int16).tobytes() for c in w.T], "w": [c[c != 0].tobytes() for c in w.T], "bias": bias, "t": t}))

    # one task of an executor fits the sample, whose size is bounded; the driver gets the weights alone
    got = _sample(rows).mapInPandas(vectors, "lang string, h long, at binary, x binary").repartition(1).sortWithinPartitions("h", "lang")
    got = got.mapInPandas(fit, "lang string, at binary, w binary, bias double, t double").toPandas().sort_values("lang")
    w = np.zeros((BUCKETS, len(got)))
    for k, (at, v) in enumerate(zip(got["at"], got["w"], strict=True)):
        w[np.frombuffer(at, np.int16), k] = np.frombuffer(v, float)
    return Model(list(got["lang"]), idf, w, got["bias"].to_numpy(float), float(got["t"].iloc[0]) if len(got) else 1.0)


def held_out(doc_id: Column) -> Column:
    """True for the documents that op4's contract keeps from learning; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred and score (the calibrated probability), from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain: a class would have to be installed on the executors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for x in by_size(batches, "_text"):
            pred, score = [UNKNOWN] * len(x), np.zeros(len(x))
            for k, (text, known) in enumerate(zip(x["_text"], x["_letters"], strict=True)):
                if known and m.langs:
                    at, v = _vector(text, m.idf)
                    s = (v @ m.weights[at] + m.bias) / m.temperature
                    p = np.exp(s - s.max())
                    best = int(p.argmax())
                    pred[k], score[k] = m.langs[best], p[best] / p.sum()
            yield plain(x[keep].assign(lang_pred=pred, score=score))

    rows = docs.select(*keep, F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    kept = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return rows.mapInPandas(run, f"{kept}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    Only text and lang of rows that are not held out, with an id, teach the model; a prediction sees the text alone. A
    text that is null, empty or without a letter is `und` with score 0, as is every text if there is nothing to learn
    from. Ties go to the language that is first in code point order. Rows that repeat come back as often. Other columns
    are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(rows, model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is unknown or less than `least` sure; a null lang gets the prediction."""
    model = train(docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    # a prediction depends on the text alone, so its hash names it; only what is rejected or filled in is joined
    said = docs.select(F.xxhash64("text").alias("h"), F.col("lang").isNull().alias("missing"), "text")
    said = materialize(predict(said, model, ["h", "missing"]), "predictions")
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    h, f, lang = unused(docs, "h"), unused(docs, "f"), unused(docs, "filled")
    bad = materialize(said.filter(~good).select(F.col("h").alias(h)).distinct(), "rejected")
    fill = materialize(said.filter(good & F.col("missing")).groupBy(F.col("h").alias(f)).agg(F.first("lang_pred").alias(lang)), "filled")
    # few of them go to every task, so that texts stay where they are
    bad, fill = (F.broadcast(x) if small_enough(x, BROADCAST_ROWS) else x for x in (bad, fill))
    kept = docs.withColumn(h, F.xxhash64("text")).join(bad, h, "left_anti")
    kept = kept.join(fill, F.col("lang").isNull() & (F.col(h) == F.col(f)), "left")
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)
