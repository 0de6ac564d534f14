"""SimHash near-duplicates found exactly with a forest of vantage-point trees.

A fingerprint of 64 bits is cut into `bands` groups of bits. Of two fingerprints at `max_bits` or fewer differing bits,
at least one band differs in at most r = max_bits // bands bits, so it suffices to find, in each band, all pairs within
r under that band's Hamming distance (a metric). One vantage-point tree a band does that: a node sends a fingerprint
inside if its distance to the node's vantage point is at most the node's radius, else outside. The triangle bound tells
which others may be its partners: a fingerprint that lies within r of the boundary also visits the other side. A leaf
is a shard; a pair meets where one of the two is at home, and the full 64 bits decide. So the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..workspace import by_size, materialize, small_enough, unused

SEED = 42
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 500_000
#: A fingerprint that more than one in so many rows have is joined apart from the others.
HOT_SHARE = 10_000
#: Rows of keys up to which they are broadcast.
KEY_ROWS = 2_000_000
#: Times seen beyond which a shingle goes behind the others, and so many of those at most.
COMMON, COMMON_ROWS = 32, 500_000
#: Rows of shingle lists, and pairs of texts, that a group of a task holds, about.
BUCKET_ROWS, PART_PAIRS = 250_000, 20_000
#: Texts, and members of their sets, of a block of a large class, about; classes of over SPLIT texts are up to SPARE blocks.
BLOCK_TEXTS, BLOCK_MEMBERS, SPLIT, SPARE = 2_048, 2_000_000, 256, 8


def simhash(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint (unsigned) of one whole text; 0 if it has no words.

    A-Z become lower case; words are what ASCII white space separates. Repeated shingles count each time. A bit is set
    if more than half of the shingles' XXH64 have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    totals = np.zeros(64, np.int64)
    for k in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[k : k + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)  # eight sums of up to 255 in each
        totals += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_size(batches, "t"):
            fp = np.array([simhash(t, shingle) for t in x["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"], "fp": fp})

    # ids travel as strings: a long among nulls would be rounded on its way
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _masks(bands: int) -> list[int]:
    cuts = [64 * k // bands for k in range(bands + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _grow(sample: np.ndarray, mask: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of that depth as a heap: vantage points and radii of its inner nodes."""
    rng = np.random.default_rng(seed)
    n = (1 << depth) - 1
    points, radii = np.zeros(n, np.uint64), np.zeros(n, np.int16)
    held = {0: sample & np.uint64(mask)}
    for node in range(n):
        own = held.pop(node, np.zeros(0, np.uint64))
        best = None
        for v in own[rng.integers(0, len(own), 6)] if len(own) else ():
            d = np.bitwise_count(own ^ v).astype(np.int16)
            for radius in {int(np.quantile(d, 0.5, method="lower")), int(np.quantile(d, 0.5, method="lower")) - 1}:
                cost = abs(np.mean(d <= radius) - 0.5) + 0.5 * np.mean((d == radius) | (d == radius + 1))
                if best is None or cost < best[0]:
                    best = (cost, v, radius, d)
        if best is None:
            continue
        points[node], radii[node] = best[1], best[2]
        inside = best[3] <= best[2]
        held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
    return points, radii


def _place(fps: np.ndarray, mask: int, tree: tuple[np.ndarray, np.ndarray], depth: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, at home): each fingerprint once at home, and as a visitor wherever a partner may be at home.

    Of two that part at a node, the inner one follows the outer one; from there on it visits both sides of every
    boundary that lies within r.
    """
    points, radii = tree
    row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    for _ in range(depth):
        d = np.bitwise_count((fps[row] ^ points[node]) & np.uint64(mask)).astype(np.int16)
        mu = radii[node]
        inside = d <= mu
        into = inside | (~home & (d - r <= mu))
        out = ~inside | (d + r > mu)
        row = np.concatenate([row[into], row[out]])
        node, home = np.concatenate([2 * node[into] + 1, 2 * node[out] + 2]), np.concatenate([home[into] & inside[into], home[out] & ~inside[out]])
    return row, node - ((1 << depth) - 1), home


def _local_stars(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components of the fingerprints that meet in one leaf."""
    own = fps[home]
    linked = np.zeros(len(fps), bool)
    step = max(1, 2_000_000 // max(1, len(fps)))
    at = np.flatnonzero(home)
    for k in range(0, len(own), step):
        near = np.bitwise_count(own[k : k + step, None] ^ fps[None, :]) <= max_bits
        near[np.arange(near.shape[0]), at[k : k + step]] = False
        linked |= near.any(axis=0)
        linked[at[k : k + step]] |= near.any(axis=1)
    left = np.unique(fps[linked])
    ends, roots = [], []
    while len(left):
        group, front = [left[:1]], left[:1]
        left = left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 2_000_000 // len(left))
            for k in range(0, len(front), step):
                hit |= (np.bitwise_count(front[k : k + step, None] ^ left[None, :]) <= max_bits).any(axis=0)
            front, left = left[hit], left[~hit]
            group.append(front)
        members = np.concatenate(group)
        if len(members) > 1:
            ends.append(members)
            roots.append(np.full(len(members), members.min(), np.uint64))
    if not ends:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(ends), np.concatenate(roots)


def _local_pairs(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within max_bits of the fingerprints that meet in one leaf: each one's nearest, and a tree over each component."""
    at = np.flatnonzero(home)
    linked = np.zeros(len(fps), bool)
    ends, others = [], []
    step = max(1, 2_000_000 // max(1, len(fps)))
    for k in range(0, len(at), step):
        rows = at[k : k + step]
        bits = np.bitwise_count(fps[rows, None] ^ fps[None, :])
        bits[np.arange(len(rows)), rows] = 255
        near = bits <= max_bits
        linked |= near.any(axis=0)
        hit = near.any(axis=1)
        linked[rows] |= hit
        ends.append(fps[rows[hit]])
        others.append(fps[bits[hit].argmin(axis=1)])
    left = np.unique(fps[linked])
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            step = max(1, 2_000_000 // len(left))
            for k in range(0, len(front), step):
                near = np.bitwise_count(front[k : k + step, None] ^ left[None, :]) <= max_bits
                new = near.any(axis=0) & (parent < 0)
                parent[new] = k + near[:, new].argmax(axis=0)
            hit = parent >= 0
            ends.append(left[hit])
            others.append(front[parent[hit]])
            front, left = left[hit], left[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *ends]), np.concatenate([none, *others])


def link_fingerprints(distinct: DataFrame, max_bits: int = 4, bands: int = 3, leaf_rows: int = 1024, split_rows: int = 32_768, max_depth: int = 16, pairs: bool = False) -> DataFrame:
    """(src, dst): edges that connect the same fingerprints as all pairs within max_bits do, without listing all pairs.

    With `pairs` each edge is itself such a pair: in each leaf the nearest partner of each, and a tree over the linked ones.

    distinct has one column fp (long), each value once. The trees are fitted on a sample of at most 8 * 2**max_depth
    fingerprints; every fingerprint is placed. A leaf of over split_rows rows is dealt out as pairs of blocks, each
    pair to a task of its own, so that no task holds an unbounded group; no pair is left out.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1, n) / leaf_rows))))
    sample = np.array([x.fp for x in distinct.orderBy(F.xxhash64("fp"), "fp").limit(8 << depth).collect()], np.int64).view(np.uint64)
    masks, r = _masks(bands), max_bits // bands
    trees = spark.sparkContext.broadcast([_grow(sample, m, depth, 7 + k) for k, m in enumerate(masks)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fps = x["fp"].to_numpy(np.int64).view(np.uint64)
            for k, mask in enumerate(masks):
                row, leaf, home = _place(fps, mask, trees.value[k], depth, r)
                yield pd.DataFrame({"leaf": (leaf * bands + k).astype(np.int32), "fp": fps[row].view(np.int64), "home": home})

    placed = materialize(distinct.select("fp").mapInPandas(place, "leaf int, fp long, home boolean"), "placed")
    sizes = {x.leaf: x["count"] for x in placed.groupBy("leaf").count().filter(F.col("count") > split_rows).collect()}  # one a leaf at most

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x = x.assign(a=np.int32(0), b=np.int32(0))
            hot = x["leaf"].isin(sizes.keys())
            yield x[~hot]
            for leaf, part in x[hot].groupby("leaf"):
                blocks = -(-sizes[leaf] // split_rows) + 1
                own = (pd.util.hash_array(part["fp"].to_numpy()) % blocks).astype(np.int32)
                for other in range(blocks):
                    yield part.assign(a=np.minimum(own, other).astype(np.int32), b=np.maximum(own, other).astype(np.int32))

    def link(x: pd.DataFrame) -> pd.DataFrame:
        fps = x["fp"].to_numpy(np.int64).view(np.uint64)
        ends, roots = (_local_pairs if pairs else _local_stars)(fps, x["home"].to_numpy(bool), max_bits)
        return pd.DataFrame({"src": ends.view(np.int64), "dst": roots.view(np.int64)})

    dealt = placed.mapInPandas(deal, "leaf int, fp long, home boolean, a int, b int") if sizes else placed.withColumns({"a": F.lit(0), "b": F.lit(0)})
    return dealt.groupBy("leaf", "a", "b").applyInPandas(link, "src long, dst long")


def _labelled(prints: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """prints with the columns of classes (key, n, others), a row a key; n says how many of prints have it.

    A key with more than its share of all rows goes to every task, so that none of them reads all its rows.
    """
    most = max(256, prints.count() // HOT_SHARE)
    hot = F.broadcast(classes.filter(F.col("n") > most).drop("n"))  # HOT_SHARE rows at most
    cold = prints.join(F.broadcast(classes.filter(F.col("n") > most).select(key)), key, "left_anti").join(classes.drop("n"), key)
    return prints.join(hot, key).unionByName(cold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest doc_id that a row reaches over links of at most max_bits differing bits, its own
    included. Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated
    rows come back as often. A row with a null doc_id links others and gets its component_id, which is null if no
    member has an id. An empty table gives an empty result; other columns are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    edges = link_fingerprints(reps.select("fp"), max_bits)
    roots = connected_components(edges)
    # only fingerprints that stand on an edge need more than their own smallest id
    linked = roots.join(reps, roots.node == reps.fp).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    class_of = materialize(reps.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n"), "classes")
    both = _labelled(prints, class_of, "fp")
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles; of one with fewer words, that of them all."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    at = np.fromiter(map(xxh64_intdigest, own), np.uint64, len(own))
    n = min(words, len(own))
    mixed = np.full(max(0, len(own) - n + 1) if n else 0, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + at[k : k + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many texts share, in ascending order, and the logarithm of in how many each was seen.

    Seen are shingles that two texts of one batch share. This sets an order only: no result depends on what is missed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_size(batches, "t"):
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *[_shingles(t, words) for t in set(x["t"])]]), return_counts=True)
            yield pd.DataFrame({"s": found[n > 1], "n": n[n > 1]})

    seen = texts.select("t").mapInPandas(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON)
    seen = seen.orderBy(F.desc("n"), "s").limit(COMMON_ROWS).toPandas().sort_values("s")  # COMMON_ROWS at most
    return seen["s"].to_numpy(np.int64), np.log2(seen["n"].to_numpy(float)).astype(np.int8)


def _bounds(*keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys the end of the run of equal ones that it stands in."""
    n = len(keys[0])
    change = np.zeros(max(0, n - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)
    return np.repeat(cuts[1:], np.diff(cuts))


def _met(x: pd.DataFrame, similarity: float, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of x whose texts share a key and may be that similar by their sizes and the key's places, in parts.

    With `every` all pairs of different labels; else each text and the next one, in an order that differs from key to key.
    """
    key, h, size, pos, label = (x[c].to_numpy() for c in ("key", "h", "size", "pos", "label"))
    mixed = (h.view(np.uint64) ^ key.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((h, label, key) if every else (h, mixed, key))
    key, size, pos, label = key[order], size[order].astype(np.int64), pos[order].astype(np.int64), label[order]
    end, first = _bounds(key), _bounds(key, label) if every else np.arange(1, len(key) + 1)
    reach = end - first if every else np.minimum(end - first, 1)
    total = np.cumsum(reach)
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000, "right")))
        n = reach[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        most = 1 + np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1)
        ok = (low >= similarity * high - 1e-9) & (most >= similarity / (1 + similarity) * (low + high) - 1e-9)
        yield order[i[ok]], order[j[ok]]
        at = stop


def _neighbours(x: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Pairs (u, v) of texts next to each other in a key's list that may be that similar."""
    h = x["h"].to_numpy()
    parts = [pd.DataFrame({"u": h[:0], "v": h[:0]})]
    for i, j in _met(x, similarity, False):
        parts.append(pd.DataFrame({"u": np.minimum(h[i], h[j]), "v": np.maximum(h[i], h[j])}).drop_duplicates())
    return pd.concat(parts).drop_duplicates()


def _unsettled(x: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The rows of x that share a key with a text of another label that may be that similar."""
    seen = np.zeros(len(x), bool)
    for i, j in _met(x, similarity, True):
        seen[i] = seen[j] = True
    return x[seen]


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest members of classes after each a[k] and b[k] are in one; root holds those before."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(root))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]
    return root


def _joined(x: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Edges (u, v) from texts to the smallest of their class: texts whose sketches allow a link are in one class.

    They stand for all pairs of different labels in x, and are no more than its texts.
    """
    names, node = np.unique(x["h"].to_numpy(), return_inverse=True)
    size, bits, root = x["size"].to_numpy(np.int64), x["bits"].tolist(), np.arange(len(names))
    for i, j in _met(x, similarity, True):
        new = root[node[i]] != root[node[j]]
        i, j = i[new], j[new]
        ok = _apart(bits, i, j) <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + 1e-6
        root = _merged(root, node[i[ok]], node[j[ok]])
    moved = root != np.arange(len(names))
    return pd.DataFrame({"u": names[moved], "v": names[root[moved]]})


def _sketch(own: np.ndarray, times: int = 1) -> bytes:
    """A bit for each of so many parts of all hashes: whether an odd number of the set's are in it.

    Of n hashes it has the next power of two bits, 64 at least, with `times` that of so many times n; folded, it is the
    sketch of half as many parts.
    """
    bits = 1 << max(6, (times * len(own) - 1).bit_length())
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(a: bytes, width: int) -> np.ndarray:
    """A sketch as the words of one of that many bytes."""
    x = np.frombuffer(a, np.uint64)
    while 8 * len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _apart(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches i and j differ, pair by pair, as _differing() says of one."""
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least):
        at = np.flatnonzero(least == w)
        used = np.zeros(len(bits), bool)
        used[i[at]] = used[j[at]] = True
        rows, place = np.stack([_folded(bits[k], w) for k in np.flatnonzero(used)]), np.cumsum(used) - 1
        step = max(1, 4_000_000 // rows.shape[1])
        for k in range(0, len(at), step):
            part = at[k : k + step]
            out[part] = np.bitwise_count(rows[place[i[part]]] ^ rows[place[j[part]]]).sum(axis=1, dtype=np.int64)
    return out


def _differing(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the larger one folded; the sets differ in so many shingles at least."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _needed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (u, v), dealt out by u, with their part g; (g, h): the texts that a part needs, each once."""
    parts = max(64, pairs.count() // PART_PAIRS)
    dealt = pairs.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int"))
    return dealt, materialize(dealt.select("g", F.explode(F.array("u", "v")).alias("h")).distinct(), "needed")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of texts that their sketches allow to be that similar. No pair that is so is lost."""
    dealt, need = _needed(pairs)
    sketches = nodes.select("h", "size", "bits").join(F.broadcast(need) if small_enough(need, KEY_ROWS) else need, "h")

    def decide(p: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        size, bits = (dict(zip(x["h"], x[c], strict=True)) for c in ("size", "bits"))
        most = (1 - similarity) / (1 + similarity)
        ok = [_differing(bits[u], bits[v]) <= most * (size[u] + size[v]) + 1e-6 for u, v in zip(p["u"], p["v"], strict=True)]
        return p.loc[np.array(ok, bool), ["u", "v"]]

    return materialize(dealt.groupBy("g").cogroup(sketches.groupBy("g")).applyInPandas(decide, "u long, v long"), "possible")


def _linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _with_sets(need: DataFrame, named: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The rows of need, by their texts' hashes h in named, with s, the whole set of shingles; a row may come twice."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_size(batches, "t"):
            x = x.drop_duplicates("h")
            yield pd.DataFrame({"h": x["h"], "s": [_shingles(t, words) for t in x["t"]]})

    ids = materialize(need.select("h").distinct().join(nodes.select("h", "rep"), "h"), "ids")
    if small_enough(need, KEY_ROWS):
        # one row of each text is taken, where it stands; only the sets are dealt out
        ids = F.broadcast(ids.select(F.col("h").alias("i"), "rep"))
        texts = named.join(ids, (F.col("h") == F.col("i")) & F.col("doc_id").eqNullSafe(F.col("rep").cast("string")), "left_semi")
        sets = texts.select("h", "t").mapInPandas(whole, "h long, s array<long>")
        need = F.broadcast(need)
    else:
        # copies become one a task before anything is dealt out by text, so that a text that many rows have is no single task
        texts = named.groupBy("h").agg(F.first("t").alias("t")).join(ids, "h", "left_semi")
        sets = materialize(texts.mapInPandas(whole, "h long, s array<long>"), "sets")
    return sets.join(need, "h")


def _alike(pairs: DataFrame, named: DataFrame, nodes: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (u, v) of texts, by their hashes h in named, whose whole sets of shingles are that similar.

    A set goes to each part of the pairs that needs it once, however many pairs it stands in there.
    """
    dealt, need = _needed(pairs)

    def decide(p: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(x["h"], x["s"], strict=True))
        sure = [_linked(held[u], held[v], similarity) for u, v in zip(p["u"], p["v"], strict=True)]
        return p.loc[np.array(sure, bool), ["u", "v"]]

    sets = _with_sets(need, named, nodes, words)
    return dealt.groupBy("g").cogroup(sets.groupBy("g")).applyInPandas(decide, "u long, v long")


def _tree(x: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links (u, v) of the texts of x that join the same labels as all its links do, one less than labels at most.

    Of two blocks only pairs across are looked at. Sketches of more bits, made here, rule out most others.
    """
    x = x.drop_duplicates("h")
    h, side, sets = x["h"].to_numpy(), x["side"].to_numpy(), x["s"].tolist()
    across = (x["a"] != x["b"]).any()
    label = np.unique(x["label"].to_numpy(), return_inverse=True)[1]
    size, bits = np.fromiter(map(len, sets), np.int64, len(sets)), [_sketch(v, 8) for v in sets]
    ends, step = [], max(1, 500_000 // max(1, len(h)))
    for k in range(0, len(h), step):
        i, j = np.nonzero(label[k : k + step, None] != label[None, :])
        i += k
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (i < j) & (low >= similarity * high - 1e-9)
        if across:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        apart = _apart(bits, i, j)
        near = np.flatnonzero(apart <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + 1e-6)
        near = near[np.argsort(apart[near], kind="stable")]
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            if label[a] != label[b] and _linked(sets[a], sets[b], similarity):
                label[label == label[b]] = label[a]
                ends.append((a, b))
    u, v = np.array(ends, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"u": h[u], "v": h[v]})


def _remaining(lists: DataFrame, to: DataFrame, named: DataFrame, nodes: DataFrame, similarity: float, words: int) -> DataFrame | None:
    """(u, v): links that join the same texts as all links between different labels of `to` (h, root) do; None if none may be.

    No row is made of a pair. A task that holds a shingle's list says only which texts may be linked directly or through
    others; each of these classes then meets with whole sets, a large one as pairs of blocks, a task of its own each.
    """
    labelled = lists.join(to, "h", "left").withColumn("label", F.coalesce("root", "h")).drop("root")
    left = materialize(labelled.groupBy("b").applyInPandas(lambda x: _unsettled(x, similarity), labelled.schema), "unsettled")
    sketches = left.join(nodes.select("h", "bits"), "h")
    near = materialize(sketches.groupBy("b").applyInPandas(lambda x: _joined(x, similarity), "u long, v long"), "near")
    if near.isEmpty():
        return None
    classes = connected_components(near, "u", "v").select(F.col("node").alias("h"), F.col("root").alias("q"))
    classes = materialize(classes.join(nodes.select("h", "size"), "h").join(to, "h", "left").withColumn("label", F.coalesce("root", "h")).drop("root"), "near_classes")
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_MEMBERS), F.least(F.ceil(n / SPLIT), F.lit(SPARE)))
    large = classes.groupBy("q").agg(blocks.cast("int").alias("blocks")).filter("blocks > 1")
    dealt = classes.join(F.broadcast(large), "q", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("h"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    need = materialize(dealt.select("q", "h", "label", "side", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b")), "needed")
    return _with_sets(need, named, nodes, words).groupBy("q", "a", "b").applyInPandas(lambda x: _tree(x, similarity), "u long, v long")


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, component_id): one row for each row of docs, grouped by the similarity of their word shingles.

    Two texts are linked if their sets of shingles of `words` words have that Jaccard similarity. Every such link counts: two
    sets of it share one of their first shingles, in any one order of all shingles, and those are n - ceil(similarity * n) + 1
    of n. Shingles that many texts share stand last in that order. Each distinct text stands once. Pairs that are next to
    each other in a shingle's list are decided first; then all others whose texts are not yet in one component, without a row
    for each of them. Pairs that the texts' sketches rule out are left; whole sets decide of the others, so no link is wrong,
    and all texts that links connect are in one component.

    component_id is the smallest doc_id that a row reaches, its own included. Texts without words, null ones too, are alike.
    Repeated rows come back as often; a row with a null doc_id links others. Other columns are not read.
    """
    # ids travel as strings: a long among nulls would be rounded on its way
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_common(named, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, level = shared.value

        def first(own: np.ndarray) -> np.ndarray:
            if not len(own):
                return np.zeros(1, np.int64)  # texts without words share this key
            n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
            at = np.searchsorted(common, own)
            known = np.append(common, 0)[at] == own if len(common) else np.zeros(len(own), bool)
            known &= at < len(common)
            rank = np.where(known, np.append(level, 0)[at], 0)
            return own[np.lexsort((own, rank))[:n]]

        for x in by_size(batches, "t"):
            sets = [_shingles(t, words) for t in x["t"]]
            yield x[["doc_id", "h"]].assign(size=[len(v) for v in sets], keys=[first(v) for v in sets], bits=[_sketch(v) for v in sets])

    prints = named.mapInPandas(run, "doc_id string, h long, size int, keys array<long>, bits binary").withColumn("doc_id", F.col("doc_id").cast(kind))
    prints = materialize(prints, "prints")
    nodes = materialize(prints.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "keys", "bits")]), "texts")
    rows = nodes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    buckets = max(256, rows // BUCKET_ROWS)
    lists = nodes.select("h", "size", F.posexplode("keys").alias("pos", "key")).withColumn("b", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def several(x: pd.DataFrame) -> pd.DataFrame:
        return x[x["key"].duplicated(keep=False)]

    lists = materialize(lists.groupBy("b").applyInPandas(several, lists.schema), "lists")

    tried = lists.withColumn("label", F.col("h")).groupBy("b").applyInPandas(lambda x: _neighbours(x, similarity), "u long, v long")
    tried = materialize(tried.distinct(), "candidates")
    sure = materialize(_alike(_possible(tried, nodes, similarity), named, nodes, similarity, words), "links")
    roots = materialize(connected_components(sure, "u", "v"), "roots")
    to = roots.select(F.col("node").alias("h"), "root")
    more = _remaining(lists, F.broadcast(to) if small_enough(to, BROADCAST_ROWS) else to, named, nodes, similarity, words)
    if more is not None:
        more = materialize(more, "links")
        roots = materialize(connected_components(sure.unionByName(more), "u", "v"), "roots")
    joined = materialize(roots.join(nodes.select("h", "rep"), roots.node == nodes.h).select("h", "root", "rep"), "joined")
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = joined.join(least, "root").select("h", "component_id")
    class_of = materialize(nodes.select("h", "n", "rep").join(moved, "h", "left").select("h", "n", F.coalesce("component_id", "rep").alias("component_id")), "classes")
    return _labelled(prints.select("doc_id", "h"), class_of, "h").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group of near_copies() the row with the smallest doc_id stays, one if it repeats.

    Rows without a doc_id can't be told apart and stay.
    """
    found = near_copies(docs.select("doc_id", "text"))
    n, h, i, lost = (unused(docs, c) for c in ("n", "h", "i", "lost"))
    # only rows that go, or stand more than once, are joined, so texts are not moved for the others
    marks = found.groupBy(F.col("doc_id").alias(i)).agg(F.max(F.col("doc_id") != F.col("component_id")).alias(lost), F.count_if(F.col("doc_id") == F.col("component_id")).alias(n))
    marks = materialize(marks.filter(F.col(lost) | (F.col(n) > 1)).select(i, lost), "marks")
    marks = F.broadcast(marks) if small_enough(marks, KEY_ROWS) else marks
    kept = docs.join(marks, F.col("doc_id") == F.col(i), "left")
    once = kept.filter(F.col(lost).isNull())
    # partial minima before the shuffle: an id that many rows share is no single task
    spare = kept.filter(~F.col(lost)).select(docs.columns).withColumn(h, F.xxhash64(*docs.columns))
    first = spare.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), h).alias(n)).select(f"{n}.*")
    return once.select(docs.columns).unionByName(first.select(docs.columns))
