"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are extended by one coordinate, so that the largest inner product becomes the smallest distance, and projected
by several random rotations of the directions in which a sample of them varies most. Each projection is shifted, quantised
and ordered along a Hilbert curve. Along each curve the vectors are range-partitioned; a query meets the window of keys
around its own, and the windows of all curves merge and are reranked by the exact inner product. How wide the windows must
be is measured: a bounded sample of queries is searched by brute force, and each curve's window grows, a step at a time,
where a step finds most of their true neighbours for the rows that it adds, until the share that is asked for is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..workspace import materialize

#: Curves; dimensions of a projection and bits of each of its coordinates (their product is below 63).
CURVES, DIMS, BITS = 4, 7, 8
#: Directions of most variance that a projection turns, beyond its dimensions.
SPARE_DIRECTIONS = 3
#: A vector that more than one in so many queries ask for is joined apart from the others.
HOT_SHARE = 10_000
#: Rows of one block of candidates: what a task holds at a time.
BLOCK_ROWS = 16_384
#: Bounds of what is fitted: queries of the sample, vectors that the scale is measured on, bins of a curve.
SAMPLE_QUERIES, SAMPLE_VECTORS, MOST_BINS = 128, 4096, 65_536


class Curves(NamedTuple):
    rotations: np.ndarray  # curve, dimension + 1, DIMS
    shift: np.ndarray  # curve, DIMS
    low: np.ndarray
    scale: np.ndarray
    longest: float


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of cells (unsigned integers below 2**bits), after Skilling."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _keys(m: np.ndarray, c: Curves, query: bool) -> np.ndarray:
    """curve by row: vectors get the coordinate that makes them all as long as the longest, queries are scaled to it."""
    norms = np.sqrt((m * m).sum(axis=1))
    if query:
        m = np.hstack([m * (c.longest / norms)[:, None], np.zeros((len(m), 1))])
    else:
        m = np.hstack([m, np.sqrt(np.maximum(c.longest**2 - norms**2, 0))[:, None]])
    out = []
    for k in range(len(c.rotations)):
        at = (m @ c.rotations[k] - c.low[k]) * c.scale[k] + c.shift[k]
        out.append(hilbert_keys(np.clip(at, 0, 2**BITS - 1).astype(np.int64), BITS))
    return np.array(out)


def _turn(rng: np.random.Generator, n: int) -> np.ndarray:
    """DIMS random directions in n dimensions, at right angles if there are enough."""
    return np.linalg.qr(rng.standard_normal((n, DIMS)))[0] if n >= DIMS else rng.standard_normal((n, DIMS))


def widths(far: np.ndarray, bins: int, recall: float) -> np.ndarray:
    """Bins to either side of a query, by curve, from far: true neighbour by curve, how many bins away it stands.

    A neighbour is found if any curve has it in its window. From windows of one bin, the step of one curve that finds most
    neighbours for each bin that it adds is taken, until the share `recall` is found.
    """
    out = np.ones(far.shape[1], np.int64)
    while len(far) and out.max() < bins:
        found = (far <= out).any(axis=1)
        if found.mean() >= recall:
            break
        best = (-1.0, 0, bins)
        for k in range(len(out)):
            steps = np.sort(far[~found, k])
            steps = steps[steps > out[k]]
            if len(steps):
                gain = np.arange(1, len(steps) + 1) / (np.minimum(2 * steps + 1, bins) - min(2 * out[k] + 1, bins) + 1e-9)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), k, int(steps[at])))
        out[best[1]] = best[2]
    # what the later steps have made needless goes again, the narrow windows first
    for k in np.argsort(out, kind="stable"):
        rest = (np.delete(far, k, axis=1) <= np.delete(out, k)).any(axis=1)
        missing = math.ceil(recall * len(far) - 1e-9) - int(rest.sum())
        left = np.sort(far[~rest, k])
        out[k] = min(out[k], max(1, int(left[missing - 1]) if 0 < missing <= len(left) else 1 if missing <= 0 else out[k]))
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: no null or non-finite component, not zero, of the commonest dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (size[0].n if size else 0))


def _best(q: np.ndarray, qids: np.ndarray, c: np.ndarray, cids: np.ndarray, top: int) -> pd.DataFrame:
    """The top candidates of each query, by inner product; scores of one pair are the same wherever it is met."""
    s = q @ c.T
    k = min(top, len(c))
    at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(len(c)), s.shape)
    row = np.repeat(np.arange(len(q)), at.shape[1])
    at = at.ravel()
    exact = (q[row] * c[at]).sum(axis=1)
    return pd.DataFrame({"q": qids[row], "c": cids[at], "score": exact})


def search(vectors: DataFrame, is_query: str, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its nearest other rows by inner product, ties to the smaller id.

    is_query is a SQL condition on id. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do those of another dimension than most. Rows with equal vectors are one candidate with its smallest ids, of
    which top + 1 suffice, so nothing is lost and no crowd of copies fills a task. Rows that repeat an id count each: a
    query's own id is never among its results. A query has fewer than `top` results only if there are no more rows.
    An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    few = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= top + 1)
    distinct = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("c"), "v", "ids"), "vectors")
    queries = rows.filter(is_query)
    asked = materialize(queries.groupBy("v").agg(F.min("id").alias("q"), F.count("*").alias("n")).select("q", "v", "n"), "queries")
    n = distinct.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n or not asked.head(1):
        return spark.createDataFrame([], out)
    dim = len(distinct.head().v)

    # fitted on bounded samples: the scale of the projections, and the longest vector (over all)
    longest = float(distinct.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0]) * (1 + 1e-9)
    some = np.array([x.v for x in distinct.select("v").orderBy(F.xxhash64("c")).limit(SAMPLE_VECTORS).collect()], float)
    rng = np.random.default_rng(29)
    ext = np.hstack([some, np.sqrt(np.maximum(longest**2 - (some**2).sum(axis=1), 0))[:, None]])
    main = np.linalg.svd(ext - ext.mean(axis=0), full_matrices=True)[2][: DIMS + SPARE_DIRECTIONS].T
    turns = np.array([main @ _turn(rng, main.shape[1]) for _ in range(CURVES)])
    at = np.einsum("nd,kdm->knm", ext, turns)
    low, high = np.quantile(at, 0.001, axis=1), np.quantile(at, 0.999, axis=1)
    # the range takes seven eighths of the grid; the shift moves it over the rest
    curves = Curves(turns, rng.random((CURVES, DIMS)) * 2**BITS / 8, low, 2**BITS * 7 / 8 / np.maximum(high - low, 1e-12), longest)
    shared = spark.sparkContext.broadcast(tuple(curves))  # plain: a class would have to be installed on the executors

    def keyed(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    keys = _keys(_matrix(x["v"]), Curves(*shared.value), query)
                    for k in range(CURVES):
                        yield x.assign(curve=np.int32(k), key=keys[k])

        return run

    kind = distinct.schema["v"].dataType.simpleString()
    placed = materialize(distinct.select("c", "v").mapInPandas(keyed(False), f"c long, v {kind}, curve int, key long"), "keys")
    bins = int(min(MOST_BINS, max(1, n // 32)))
    marks = placed.groupBy("curve").agg(F.percentile_approx("key", [k / bins for k in range(1, bins)] or [0.5], max(10_000, 2 * bins)).alias("e"))
    edges = {x.curve: np.array(x.e)[: bins - 1] for x in marks.collect()}  # CURVES times MOST_BINS at most

    # window widths: where do the true neighbours of the sampled queries stand, in bins from the query?
    probe = asked.orderBy(F.xxhash64("q")).limit(SAMPLE_QUERIES).toPandas()
    pm, pids = _matrix(probe["v"]), probe["q"].to_numpy()
    pkeys = _keys(pm, curves, True)
    tried = spark.sparkContext.broadcast((pm, pids))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield _best(*tried.value, _matrix(x["v"]), x["c"].to_numpy(), top)

    truth = distinct.select("c", "v").mapInPandas(brute, "q long, c long, score double")
    truth = truth.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("r") <= top)
    near = truth.select("q", "c").join(placed.select("c", "curve", "key"), "c").toPandas()
    where = {q: k for k, q in enumerate(pids)}
    far = []
    for k in range(CURVES):
        own = near[near["curve"] == k].sort_values(["q", "c"])
        mine = np.searchsorted(edges[k], pkeys[k][[where[q] for q in own["q"]]], side="right")
        far.append(np.abs(np.searchsorted(edges[k], own["key"].to_numpy(), side="right") - mine))
    width = widths(np.array(far).T, bins, recall)

    # blocks of whole bins; a block of more than BLOCK_ROWS rows is split by hash, never cut
    counts = {}
    edge = spark.sparkContext.broadcast(edges)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            b = np.zeros(len(x), np.int32)
            for k in range(CURVES):
                own = (x["curve"] == k).to_numpy()
                b[own] = np.searchsorted(edge.value[k], x["key"][own].to_numpy(), side="right")
            yield x.assign(bin=b)[["c", "v", "curve", "bin"]]

    spots = materialize(placed.mapInPandas(binned, f"c long, v {kind}, curve int, bin int"), "bins")
    for x in spots.groupBy("curve", "bin").count().collect():  # CURVES times MOST_BINS rows at most
        counts.setdefault(x.curve, np.zeros(bins, np.int64))[x.bin] = x["count"]
    block, parts = {}, {}
    for k in range(CURVES):
        block[k] = np.minimum((np.cumsum(counts[k]) - counts[k]) // BLOCK_ROWS, bins)
        sizes = np.bincount(block[k], weights=counts[k])
        parts[k] = np.maximum(1, -(-sizes // (2 * BLOCK_ROWS))).astype(int)
    layout = spark.sparkContext.broadcast((block, parts, width))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, _ = layout.value
        for x in batches:
            b = np.array([block[k][i] for k, i in zip(x["curve"], x["bin"], strict=True)], np.int32)
            p = np.array([parts[k][j] for k, j in zip(x["curve"], b, strict=True)], np.int64)
            yield x.assign(block=b, part=(x["c"].to_numpy() % np.maximum(p, 1)).astype(np.int32))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, width = layout.value
        for x in batches:
            if not len(x):
                continue
            keys = _keys(_matrix(x["v"]), Curves(*shared.value), True)
            for k in range(CURVES):
                at = np.searchsorted(edge.value[k], keys[k], side="right")
                lo, hi = np.maximum(at - width[k], 0), np.minimum(at + width[k], len(block[k]) - 1)
                got = [(i, j, p) for i, (a, b) in enumerate(zip(block[k][lo], block[k][hi], strict=True)) for j in range(a, b + 1) for p in range(parts[k][j])]
                i, j, p = np.array(got, np.int64).reshape(-1, 3).T
                yield pd.DataFrame({"q": x["q"].to_numpy()[i], "v": x["v"].to_numpy()[i], "lo": lo[i].astype(np.int32), "hi": hi[i].astype(np.int32), "curve": np.int32(k), "block": j.astype(np.int32), "part": p.astype(np.int32)})

    def meet(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64", "score": "float64"})
        cs = cs.sort_values(["bin", "c"])
        c, cids, b = _matrix(cs["v"]), cs["c"].to_numpy(), cs["bin"].to_numpy()
        found = []
        for (lo, hi), own in qs.groupby(["lo", "hi"]):
            a, z = np.searchsorted(b, lo, "left"), np.searchsorted(b, hi, "right")
            for k in range(0, len(own) if z > a else 0, 256):
                found.append(_best(_matrix(own["v"][k : k + 256]), own["q"].to_numpy()[k : k + 256], c[a:z], cids[a:z], top + 1))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64", "score": "float64"})

    there = spots.mapInPandas(deal, f"c long, v {kind}, curve int, bin int, block int, part int").groupBy("curve", "block", "part")
    here = asked.mapInPandas(ask, f"q long, v {kind}, lo int, hi int, curve int, block int, part int").groupBy("curve", "block", "part")
    met = here.cogroup(there).applyInPandas(meet, "q long, c long, score double").groupBy("q", "c").agg(F.max("score").alias("score"))
    # merge: top + 1 distinct vectors hold top other rows; then their rows, and the query's own id goes
    met = met.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("r") <= top + 1)
    lists = met.join(distinct.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    lists = lists.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= top + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    lists = materialize(asked.join(lists, "q").select("v", "n", "near"), "lists")
    each = queries.select(F.col("id").alias("query_id"), "v")
    # a vector with more than its share of the queries goes to every task, so that none of them reads all its rows
    most = max(256, (asked.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = lists.filter(F.col("n") > most)  # HOT_SHARE rows at most
    cold = each.join(F.broadcast(hot.select("v")), "v", "left_anti").join(lists.select("v", "near"), "v")
    each = each.join(F.broadcast(hot.select("v", "near")), "v").select("query_id", "near").unionByName(cold.select("query_id", "near"))
    each = each.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
