"""The queries over whole tables against brute force; the ids lie beyond the bounds of the queries over id subsets."""

import datetime
import hashlib
import itertools
from collections import Counter, defaultdict

from lumenarc.plans import catalog

LINES = [(5000, 11, 1), (5000, 900, 2), (5000, 901, 3), (5001, 11, 2), (5001, 900, 1), (5001, 900, 1), (5002, 901, 3), (5002, 902, 1), (5003, 902, 2)]
NATION = {1: 7, 2: 8, 3: 9}
ORDERS = [(4000, 1), (4039, 2), (4040, 2), (4100, 3), (9000, 4), (9001, 3), (90000, 5)]
START = datetime.datetime(2024, 1, 1)
EVENTS = [(1, 0, "view", 1), (2, 24, "view", 1), (3, 25, "view", 1), (4, 1, "click", 1), (5, 2, "signup", 2), (6, 2, "signup", 2), (7, 3, "error", 2), (8, 30, "error", 2)]


def tables(spark, path):
    made = {
        "lineitem": (LINES, "l_orderkey long, l_partkey long, l_suppkey long"),
        "supplier": (list(NATION.items()), "s_suppkey long, s_nationkey long"),
        "orders": (ORDERS, "o_orderkey long, o_custkey long"),
        "events": ([(i, START + datetime.timedelta(hours=h), e, u) for i, h, e, u in EVENTS], "event_id long, ts timestamp_ntz, event_type string, user_id long"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_whole_tables(spark, tmp_path):
    tables(spark, tmp_path)
    run = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    held = defaultdict(set)
    for o, p, _ in LINES:
        held[o].add(p)
    pairs = Counter(x for v in held.values() for x in itertools.combinations(sorted(v), 2))
    assert run("cooccurrence_edges_all") == sorted((a, b, n, n + 1.0) for (a, b), n in pairs.items())
    assert run("graph_related_all") == sorted((a + b - 11, n + 1.0) for (a, b), n in pairs.items() if 11 in (a, b))
    parts = defaultdict(set)
    for _, p, s in LINES:
        parts[NATION[s]].add(p)
    shared = {(a, b): len(parts[a] & parts[b]) for a, b in itertools.combinations(sorted(parts), 2)}
    assert run("project_overlap_all") == sorted((a, b, n) for (a, b), n in shared.items() if n and n >= 0.5 * min(len(parts[a]), len(parts[b])))
    near = [(a, b, 1, float(y - x)) for (a, x, e, u), (b, y, f, v) in itertools.product(EVENTS, EVENTS) if (e, u) == (f, v) and (x, a) < (y, b) and y - x <= 24]
    assert run("similar_pairs_window_all") == sorted(near) and len(near) == 3
    root = {n: n for o, c in ORDERS for n in (c, -(o // 40) - 1)}
    for _ in ORDERS:
        for o, c in ORDERS:
            root[c] = root[-(o // 40) - 1] = min(root[c], root[-(o // 40) - 1])
    assert run("graph_components_all") == sorted(root.items())


def test_highlights_past_the_start(spark, tmp_path):
    rows = [(1, "x" * 300 + " The action"), (2, "the " * 100), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    marked = ["x" * 300 + " <mark>The</mark> ac<mark>tion</mark>", "<mark>the</mark> " * 100, None, ""]
    got = {r.doc_id: r.digest for r in catalog.queries()["highlights_all"](spark, str(tmp_path)).collect()}
    assert got == {k + 1: m if m is None else hashlib.sha256(m.encode()).hexdigest() for k, m in enumerate(marked)}
