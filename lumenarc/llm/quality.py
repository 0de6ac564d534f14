"""Quality classifier: an interpolated modified Kneser-Ney model of character trigrams, trained on trusted text.

Symbols are code points, all of them, and each language that has trusted text has a model of its own. Grouped count tables
give the discounted probabilities of three orders; the model is a table sharded by language and context. Documents are
dealt into batches of some megabytes. A batch counts each context once, however often its texts have it, and those contexts
are joined to the sharded table; what comes back meets the batch's texts again, which gives every document's perplexity.
So the join grows with the contexts of a batch, not with the words of the corpus, and nothing of the model is collected
or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..workspace import by_size, materialize, plain, small_enough, unused

POOLED = "*"
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of text in one batch, characters that are worked on at once, batches that share one copy of the model's rows.
BATCH_BYTES, WINDOW, BATCHES_PER_COPY = 4_000_000, 1 << 19, 4096
#: Bits of a symbol: 0 is the edge of a text, others are a code point and one.
BITS = 21
MASK = (1 << BITS) - 1
#: Held-out trusted texts that a language must have for its own quantile to stand alone.
LEAST_HELD = 200


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes): for each character of the texts its row and its trigram, in portions of about WINDOW characters."""
    rows, codes, held = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(points), WINDOW):
            part = points[max(0, at - 2) : at + WINDOW].astype(np.int64) + 1
            s = np.concatenate([np.zeros(2 - min(2, at), np.int64), part])
            codes.append((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:])
            rows.append(np.full(len(codes[-1]), k))
            held += len(codes[-1])
            if held >= WINDOW:
                yield np.concatenate(rows), np.concatenate(codes)
                rows, codes, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(codes)


def good_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose labels all say good quality and not toxic."""
    seen = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return seen.filter("q = 1 and x = 0 and doc_id is not null").select("doc_id")


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def held_out(text: str = "text"):
    """True for the trusted texts that teach nothing and set the thresholds: a fifth, copies together."""
    return F.pmod(F.xxhash64(text, F.lit(3)), F.lit(5)) == 0


def trigrams(rows: DataFrame) -> DataFrame:
    """(lang, a, b, c, n): the trigrams of all texts of rows (lang, text), for their language and for the pool."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_size(batches, "text"):
            for lang, own in x.groupby("lang"):
                for _, codes in _pieces(list(own["text"])):
                    found, n = np.unique(codes, return_counts=True)
                    yield plain(pd.DataFrame({"lang": lang, "a": (found >> 2 * BITS).astype(np.int32), "b": (found >> BITS & MASK).astype(np.int32), "c": (found & MASK).astype(np.int32), "n": n}))

    rows = rows.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text")
    own = rows.mapInPandas(run, "lang string, a int, b int, c int, n long").groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))
    # a text of a language counts in the pool as well
    both = F.explode(F.when(F.col("lang") == POOLED, F.array(F.lit(POOLED))).otherwise(F.array("lang", F.lit(POOLED))))
    return own.withColumn("lang", both).groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))


def model(tri: DataFrame) -> DataFrame:
    """(lang, a, b, gamma, size, cs, ps): a row a context, a = -1 for a single symbol, b = -1 for none.

    ps are the discounted shares of the symbols cs in their context, gamma is what the discounts leave to the next lower
    order. Lower orders count continuations, as Kneser and Ney have it; the three discounts of each order come from its
    counts of counts, after Chen and Goodman, and where one can't be had it is 1/2 for single counts and 1 for others.
    size, for the empty context, is the number of symbols and one for all that never occurred.
    """
    none = F.lit(-1)
    two = tri.groupBy("lang", "b", "c").agg(F.count("*").alias("n"))
    one = tri.select("lang", "b", "c").distinct().groupBy("lang", "c").agg(F.count("*").alias("n"))
    all_ = tri.select("lang", "a", "b", "c", "n").unionByName(two.select("lang", none.alias("a"), "b", "c", "n")).unionByName(one.select("lang", none.alias("a"), none.alias("b"), "c", "n"))
    order = F.when(F.col("b") < 0, 1).when(F.col("a") < 0, 2).otherwise(3)
    all_ = materialize(all_.withColumn("ord", order), "orders")
    few = all_.filter("n <= 4").groupBy("lang", "ord").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    for k in (1, 2, 3):
        d = F.lit(float(k)) - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        few = few.withColumn(f"d{k}", F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0) & d.between(0.05, k - 0.05), d).otherwise(F.lit(0.5 if k == 1 else 1.0)))
    few = materialize(few.select("lang", "ord", "d1", "d2", "d3"), "discounts")
    rows = all_.join(_side(few), ["lang", "ord"], "left")
    d = F.when(F.col("n") == 1, F.coalesce("d1", F.lit(0.5))).when(F.col("n") == 2, F.coalesce("d2", F.lit(1.0))).otherwise(F.coalesce("d3", F.lit(1.0)))
    rows = rows.select("lang", "a", "b", "c", "n", d.alias("d"))
    # a context has as many entries as there are symbols at most
    rows = rows.groupBy("lang", "a", "b").agg(F.sum("n").alias("mass"), F.sum("d").alias("left"), F.collect_list(F.struct("c", (F.col("n") - F.col("d")).alias("p"))).alias("x"))
    ps = F.transform("x", lambda x: (x["p"] / F.col("mass")).cast("double"))
    return rows.select("lang", "a", "b", (F.col("left") / F.col("mass")).alias("gamma"), (F.size("x") + 1).alias("size"), F.transform("x", lambda x: x["c"]).alias("cs"), ps.alias("ps"))


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model, written, of the trusted texts among docs that are not held out. Without any it has no rows."""
    rows = docs.select("doc_id", "lang", "text").join(_side(good_ids(labels)), "doc_id", "left_semi").filter(F.length("text") > 0)
    return materialize(model(materialize(trigrams(rows.filter(~held_out()).select("lang", "text")), "trigrams")), "model")


def _contexts(x: pd.DataFrame) -> pd.DataFrame:
    """The contexts of one batch, each once."""
    out = []
    for lang, own in x.groupby("lang_model"):
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *(pd.unique(codes >> BITS) for _, codes in _pieces(list(own["text"])))]))
        single = np.unique(found & MASK)
        a = np.concatenate([found >> BITS, np.full(len(single) + 1, -1)])
        b = np.concatenate([found & MASK, single, [-1]])
        out.append(pd.DataFrame({"batch": x["batch"].iloc[0], "lang": lang, "a": a.astype(np.int32), "b": b.astype(np.int32)}))
    return plain(pd.concat(out)) if out else pd.DataFrame({"batch": [], "lang": [], "a": [], "b": []})


class _Order:
    """The contexts of one order that a batch has: sorted keys, gammas, and sorted codes of entries with their shares."""

    def __init__(self, key: np.ndarray, rows: pd.DataFrame) -> None:
        by = np.argsort(key)
        self.key, self.gamma = key[by], rows["gamma"].to_numpy(float)[by]
        lengths = rows["cs"].map(len).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        codes = np.concatenate([np.zeros(0, np.int64), *rows["cs"]]).astype(np.int64) | np.repeat(key, lengths) << BITS
        by = np.argsort(codes)
        self.codes, self.ps = codes[by], np.concatenate([np.zeros(0), *rows["ps"]])[by]

    def interpolated(self, context: np.ndarray, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
        gamma, p = np.ones(len(code)), np.zeros(len(code))
        for keys, values, wanted, into in ((self.key, self.gamma, context, gamma), (self.codes, self.ps, code, p)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                into[hit] = values[at[hit]]
        return p + gamma * lower


def _bits(texts: list[str | None], table: pd.DataFrame) -> np.ndarray:
    """The sum of -log2 probability over each whole text; table holds their contexts of one language."""
    a, b = table["a"].to_numpy(np.int64), table["b"].to_numpy(np.int64)
    three, two, one = ((a >= 0), (a < 0) & (b >= 0), b < 0)
    orders = [_Order(np.zeros(one.sum(), np.int64), table[one]), _Order(b[two], table[two]), _Order(a[three] << BITS | b[three], table[three])]
    size = float(table["size"][one].iloc[0]) if one.any() else 1.0
    bits = np.zeros(len(texts))
    for rows, codes in _pieces(texts):
        inverse, code = pd.factorize(codes)
        p = np.full(len(code), 1 / size)
        p = orders[0].interpolated(np.zeros(len(code), np.int64), code & MASK, p)
        p = orders[1].interpolated(code >> BITS & MASK, code & (1 << 2 * BITS) - 1, p)
        p = orders[2].interpolated(code >> BITS, code, p)
        bits += np.bincount(rows, -np.log2(p)[inverse], minlength=len(texts))
    return bits


def score(docs: DataFrame, trained: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_model, n_chars_scored and bits (the sum of -log2 probability over the whole text).

    A language without a model is measured with the pooled one. The texts are dealt out once; both the contexts of a batch
    and the join of what comes back read that one shuffle.
    """
    langs = materialize(trained.filter("b = -1").select(F.col("lang").alias("lang_model")), "languages")
    rows = docs.select(*keep, F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    rows = rows.join(_side(langs), rows["_lang"] == langs["lang_model"], "left").drop("_lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = int(size // BATCH_BYTES + 1)
    rows = rows.withColumns({"lang_model": F.coalesce("lang_model", F.lit(POOLED)), "batch": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches))})
    rows = rows.withColumnRenamed("_text", "text") if "text" not in keep else rows
    kept = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    dealt = rows.groupBy("batch")
    found = dealt.applyInPandas(_contexts, "batch long, lang string, a int, b int")
    copies = batches // BATCHES_PER_COPY + 1
    if copies == 1:
        table = found.join(trained, ["lang", "a", "b"])
    else:  # a context that all batches have is no single task
        spread = trained.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        table = found.withColumn("copy", F.pmod("batch", F.lit(copies))).join(spread, ["lang", "a", "b", "copy"]).drop("copy")

    def run(x: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(len(x))
        for lang, at in x.groupby("lang_model").indices.items():
            bits[at] = _bits(list(x["text"].iloc[at]), t[t["lang"] == lang])
        n = x["text"].map(lambda v: len(v) if v else 0).to_numpy(np.int64)
        return plain(x[[*keep, "lang_model"]].assign(n_chars_scored=n, bits=bits))

    table = table.select("batch", "lang", "a", "b", "gamma", "size", "cs", "ps")
    return dealt.cogroup(table.groupBy("batch")).applyInPandas(run, f"{kept}, lang_model string, n_chars_scored long, bits double")


def classify(docs: DataFrame, labels: DataFrame, extra: list[str] | None = None, quantile: float = 0.995, prior: int = 60) -> DataFrame:
    """(doc_id, lang_model, n_chars_scored, perplexity, threshold, keep) for each row of docs, and the columns in extra.

    perplexity is a character's, over the whole text. A document is kept if its mean bits, drawn toward its language's
    median as `prior` further characters would, are at most its language's threshold: the `quantile` of the figures, drawn
    in the same way, of the language's trusted texts that are held out from training (a fifth, by a hash of the text). For
    a language with fewer than LEAST_HELD of them, whose far quantile says little, the way from the median to the threshold
    is the larger of its own and that of all languages together. A language without trusted text is measured with the
    pooled model and threshold. Null and empty texts have no perplexity and are rejected. Without trusted text nothing else
    is rejected. Rows that repeat come back as often, also with a null doc_id; null languages are pooled. Columns not named
    are not read; columns in extra may not be called as those of the result.
    """
    extra = extra or []
    marked = docs.select("doc_id", *extra, "lang", "text", F.coalesce(held_out(), F.lit(False)).alias("_held"))
    scored = materialize(score(marked, train(docs, labels), ["doc_id", *extra, "_held"]), "scored")
    rate = scored.withColumn("rate", F.when(F.col("n_chars_scored") > 0, F.col("bits") / F.col("n_chars_scored")))
    base = rate.join(_side(good_ids(labels)), "doc_id", "left_semi").filter("_held and rate is not null")
    base = base.select(F.explode(F.array_distinct(F.array("lang_model", F.lit(POOLED)))).alias("lm"), "n_chars_scored", "bits", "rate")
    mids = materialize(base.groupBy("lm").agg(F.percentile_approx("rate", 0.5, 10_000).alias("mid"), F.count("*").alias("n")), "medians")
    drawn = (F.col("bits") + prior * F.col("mid")) / (F.col("n_chars_scored") + prior)
    marks = base.join(_side(mids), "lm").groupBy("lm", "mid", "n").agg(F.percentile_approx(drawn - F.col("mid"), quantile, 100_000).alias("way"))
    marks = materialize(marks, "marks")
    pool = marks.filter(F.col("lm") == POOLED).select(F.col("way").alias("pool_way"))
    marks = marks.join(F.broadcast(pool), how="left")  # one row
    way = F.when(F.col("n") >= LEAST_HELD, F.col("way")).otherwise(F.greatest("way", "pool_way"))
    marks = materialize(marks.select("lm", "mid", (F.col("mid") + way).alias("top")), "thresholds")
    # a language that has a model but no held-out text takes the pooled mark
    rest = marks.filter(F.col("lm") == POOLED).select(F.col("mid").alias("_mid"), F.col("top").alias("_top"))
    rows = rate.join(_side(marks), F.col("lang_model") == F.col("lm"), "left").join(F.broadcast(rest), how="left")
    rows = rows.withColumns({"mid": F.coalesce("mid", "_mid"), "top": F.coalesce("top", "_top")})
    keep = (F.col("n_chars_scored") > 0) & (F.col("mid").isNull() | (drawn <= F.col("top")))
    return rows.select("doc_id", *extra, "lang_model", "n_chars_scored", F.when(F.col("mid").isNotNull(), F.pow(F.lit(2.0), "rate")).alias("perplexity"), F.pow(F.lit(2.0), "top").alias("threshold"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that classify() rejects; their columns may have any names."""
    h = unused(docs, "h")
    named = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    bad = materialize(classify(named, labels, ["h"]).filter(~F.col("keep")).select(F.col("h").alias(h)).distinct(), "rejected")
    return docs.withColumn(h, F.xxhash64("doc_id", "lang", "text")).join(bad, h, "left_anti").select(docs.columns)
