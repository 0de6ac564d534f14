"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenarc.llm import chat, decontaminate, hilbert, langid, licenses, mixing, quality, queries, simhash, warc, webtext

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, "same words here again", "en", "a", 9), (5, "same words here again", "en", "a", 9), (5, "same words here again", "en", "a", 9), (None, "no id at all", "en", "b", 9), (6, "word " * 30000, "de", "b", 9), (7, "12345 !!", None, "b", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("clash") for c in ("key", "fp", "rep", "h", "v", "size", "pos", "_text")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_hilbert_curve_is_continuous():
    g = np.array(list(itertools.product(range(8), repeat=3)))
    k = hilbert.hilbert_keys(g, 3)
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_ann_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op1_hilbert_ann(spark, SF).toPandas()
    p = e.toPandas()
    v, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    hits = []
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        best = [i for _, i in sorted((-x, i) for x, i in zip(s, ids) if i != q)[:20]]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, [s[ids == i][0] for i in own.vec_id], atol=1e-12)
        hits.append(len(set(best) & set(own.vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_window_widths():
    far = np.array([[0, 9], [9, 0], [3, 9], [9, 9]])
    assert hilbert.widths(far, 100, 0.75).tolist() == [3, 1] and hilbert.widths(far, 100, 0.5).tolist() == [1, 1]
    assert (far <= hilbert.widths(far, 100, 1.0)).any(axis=1).all() and hilbert.widths(far[:0], 100, 0.9).tolist() == [1, 1]


def test_ann_on_clustered_vectors_reads_a_small_part(spark):
    """Recall against brute force, and how many of all pairs the windows of the curves hold."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    v = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 32))).astype(np.float32)
    v[100:140] = v[100]  # copies
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(20, v[7].tolist())], "vec_id long, embedding array<float>")
    met = []
    own = hilbert.widths
    hilbert.widths = lambda far, bins, recall: met.append((own(far, bins, recall), bins)) or met[-1][0]
    try:
        got = hilbert.search(df, "id % 20 = 0").toPandas()
    finally:
        hilbert.widths = own
    width, bins = met[0]
    assert (np.minimum(2 * width + 1, bins) / bins).sum() < 0.25
    d = v.astype(float)
    hits = []
    for q in range(0, 4000, 20):
        s = d @ d[q]
        floor = np.sort(np.delete(s, q))[-20]
        rows = got[got.query_id == q]
        assert q not in set(rows.vec_id)
        hits.append((rows.score >= floor - 1e-9).sum() / 20 if q != 20 else 1.0)
    assert np.mean(hits) >= 0.9


def test_ann_ties_and_odd_vectors(spark):
    rows = [(k, [1.0, 0.0, 0.0], 1) for k in range(60)] + [(100, None, 1), (120, [0.0, 0.0, 0.0], 1), (140, [1.0, None, 0.0], 1), (160, [float("nan"), 1.0, 0.0], 1), (180, [1.0], 1), (61, [0.5, 0.5, 0.0], 1)]
    got = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids int"), "id % 20 = 0").toPandas()
    assert set(got.query_id) == {0, 20, 40}
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == list(range(1, 21))
    assert list(got[got.query_id == 20].sort_values("rank").vec_id) == list(range(20))
    assert hilbert.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "id % 20 = 0").count() == 0


def test_licenses(spark, docs, empty):
    f = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("c/x.py", "code"), ("a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/y.py", "# This work is licensed under the GNU General Public License, version 3.\nfoo"), ("a/b/c/d/z.py", None), (None, "x"), ("a/b/x.py", "code"), ("d/x", "the licensed driver had a word with us about the weather and more")], "path string, text string")
    got = sorted((r.path or "", r.license, r.origin, r.inherited_from) for r in licenses.scan(f).collect())
    assert got == sorted([("", None, "none", None), ("a/LICENSE", "MIT", "file", None), ("a/b/x.py", "MIT", "directory", "a"), ("a/b/x.py", "MIT", "directory", "a"), ("c/x.py", None, "none", None), ("a/b/c/COPYING", "Apache-2.0", "file", None), ("a/b/c/d/y.py", "GPL-3.0", "file", None), ("a/b/c/d/z.py", "Apache-2.0", "directory", "a/b/c"), ("d/x", None, "none", None)], key=lambda x: x)
    named = docs.filter(F.lower("text").rlike("(?i)(released under the|licensed under)")).count()
    assert queries.op2_licenses(spark, SF).filter("license is not null").count() == named
    assert licenses.scan(empty.withColumn("path", F.lit("x"))).count() == 0


def slow_kneser_ney(texts):
    """Bits of a text by a plain interpolated modified Kneser-Ney trigram model: dictionaries and loops over texts."""
    tri, edge = defaultdict(int), ""
    for t in texts:
        s = [edge, edge, *t]
        for k in range(2, len(s)):
            tri[tuple(s[k - 2 : k + 1])] += 1
    two, one = defaultdict(int), defaultdict(int)
    for g in tri:
        two[g[1:]] += 1
    for g in two:
        one[g[1:]] += 1

    def discounts(n):
        c = [0, *(sum(v == k for v in n.values()) for k in (1, 2, 3, 4))]
        out = [0, 0.5, 1.0, 1.0]
        for k in (1, 2, 3):
            if c[1] and c[k]:
                d = k - (k + 1) * c[1] / (c[1] + 2 * c[2]) * c[k + 1] / c[k]
                out[k] = d if 0.05 <= d <= k - 0.05 else out[k]
        return out

    d = {id(n): discounts(n) for n in (tri, two, one)}

    def p(g):
        if not g:
            return 1 / (len(one) + 1)
        n = {3: tri, 2: two, 1: one}[len(g)]
        own = {x: v for x, v in n.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = d[id(n)]
        off = sum(cut[min(v, 3)] for v in own.values())
        v = n.get(g, 0)
        return ((v - cut[min(v, 3)] if v else 0) + off * p(g[1:])) / sum(own.values())

    return lambda t: -sum(np.log2(p(tuple([edge, edge, *t][k : k + 3]))) for k in range(len(t)))


def test_quality_by_brute_force(spark, monkeypatch):
    """Bits, thresholds and decisions of every row; small batches, so that a batch holds few of the texts."""
    monkeypatch.setattr(quality, "BATCH_BYTES", 500)
    monkeypatch.setattr(quality, "BATCHES_PER_COPY", 3)
    monkeypatch.setattr(quality, "WINDOW", 16)
    import random

    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    words = {"en": ["the", "and", "thing", "other"], "xx": ["αβγ", "ααδ", "你好", "𝄞x"]}
    rows = [(k, say(words[lang], rng.randint(1, 20)), lang) for k, lang in enumerate(["en"] * 30 + ["xx"] * 20 + ["en"] * 10 + ["xx"] * 5)]
    rows += [(100, "zzqq!!" * 20, "en"), (101, say(words["en"], 9), None), (102, say(words["xx"], 9), "no model"), (103, None, "en"), (104, "", "xx"), (None, "the", "en"), (0, "again, the id of another", "en")]
    labels = [(k, 1, 0) for k in range(50)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0), (60, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.text: r.h for r in docs.select("text", quality.held_out().alias("h")).collect()}
    good = set(range(50)) - {3, 4}
    taught = [(t, v) for i, t, v in rows if i in good and not held[t]]
    models = {v: slow_kneser_ney([t for t, w in taught if v in (w, "*")]) for v in ("en", "xx", "*")}
    of = lambda v: v if v in models else "*"
    bits = {(t, v): models[of(v)](t) for _, t, v in rows if t}
    base = defaultdict(list)
    for i, t, v in rows:
        if i in good and held[t]:
            for m in {of(v), "*"}:
                base[m].append((bits[t, v], len(t)))
    at = lambda xs, q: sorted(xs)[max(0, int(np.ceil(q * len(xs))) - 1)]
    mid = {m: at([b / n for b, n in x], 0.5) for m, x in base.items()}
    drawn = lambda b, n, m: (b + 60 * mid[m]) / (n + 60)
    way = {m: at([drawn(b, n, m) - mid[m] for b, n in x], 0.995) for m, x in base.items()}
    top = {m: mid[m] + max(way[m], way["*"]) for m in base}
    got = sorted((r.doc_id or -1, r.lang_model, r.n_chars_scored, r.perplexity, r.keep, r.threshold) for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    want = []
    for i, t, v in rows:
        m = of(v)
        keep = bool(t) and drawn(bits[t, v], len(t), m) <= top[m] + 1e-12
        want.append((-1 if i is None else i, m, len(t or ""), 2 ** (bits[t, v] / len(t)) if t else None, keep, 2 ** top[m]))
    for g, w in zip(got, sorted(want, key=lambda x: (x[0] or -1, *x[1:3])), strict=True):
        assert (g[0] or -1, *g[1:3], g[4]) == (w[0] or -1, *w[1:3], w[4]) and np.allclose([g[3] or 0, g[5]], [w[3] or 0, w[5]]), (g, w)


def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got[got.quality == 1].keep.mean() > 0.94 and got[got.quality == 0].keep.mean() < 0.3
    r = quality.classify(odd, labels)
    assert r.count() == len(ODD) and {x.doc_id for x in r.filter("not keep").collect()} >= {1, 2}
    assert quality.classify(empty, labels).count() == 0 and quality.keep_good(empty, labels).columns == empty.columns
    none = quality.classify(docs, labels.limit(0))
    assert none.filter("not keep").count() == docs.filter("text is null or text = ''").count()


CLASH = ("_h", "h", "h_", "_x", "x", "_n", "n", "__h", "__f", "__lang", "f", "filled", "d", "fp", "batch", "keep", "key", "pos")


def test_stages_leave_columns_of_any_name_as_they_are(spark, docs):
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    many = docs.unionByName(docs.filter("doc_id < 9")).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})
    for stage in (lambda x: quality.keep_good(x, labels), langid.keep_known, simhash.keep_one, lambda x: decontaminate.drop_contaminated(x, items)):
        got = stage(many)
        assert got.columns == many.columns
        rows = got.collect()
        assert len(rows) > 100 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH)
    once = [r.doc_id for r in simhash.keep_one(many).collect()]
    assert len(once) == len(set(once))


def test_fingerprint_that_a_third_of_all_rows_have(spark):
    rows = [(k, "one text that many rows have in common" if k % 3 else f"text {k} of its own and no other row's {k * k}") for k in range(1500)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 1500 and {got[k] for k in range(1500) if k % 3} == {1}


def test_language(spark, docs, odd, empty):
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    r = langid.identify(odd).collect()
    assert len(r) == len(ODD) and {x.doc_id for x in r if x.lang_pred == "und"} >= {1, 2, 3, 7}
    assert langid.identify(empty).count() == 0
    assert langid.keep_known(odd).columns == odd.columns
    # a held-out language teaches nothing
    swapped = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.identify(swapped).filter("lang_pred = 'xx'").count() == 0


def test_language_vectors_and_scores_by_brute_force(spark):
    texts = ["The cat", "Ünïcode 你好 𝄞", "a", "x" * 300, "zwei drei"]

    def grams(t):
        p, out = [ord(c) for c in t.lower()], defaultdict(int)
        m, mix = 1 << 32, langid.MIX
        for n in (1, 2, 3):
            for k in range(len(p) - n + 1):
                h = p[k] * mix[0] % m
                for j in range(2, n + 1):
                    h = ((h ^ j) * mix[1] + p[k + j - 1] * mix[2]) % m
                out[(h ^ h >> 15) * mix[0] % m >> 17] += 1
        return out

    for t in texts:
        at, n = langid._buckets(t)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == grams(t)
    rows = [(k, t, lang, k) for k, (t, lang) in enumerate([("the cat and the dog " * 3 + str(k), "en") for k in range(40)] + [("der hund und die katze " * 3 + str(k), "de") for k in range(40)])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, h long"))
    df = {}
    for _, t, _, _ in rows:
        for g in grams(t):
            df[g] = df.get(g, 0) + 1
    assert model.langs == ["de", "en"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", "12 !?"])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        x = {g: (1 + np.log(n)) * (np.log(81 / (1 + df.get(g, 0))) + 1) for g, n in grams(t).items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[g, c] for g, v in x.items()) + model.bias[c]) / model.temperature for c in range(2)]
        p = np.exp(z) / np.exp(z).sum()
        assert got[k].lang_pred == model.langs[int(p.argmax())] and got[k].score == pytest.approx(p.max())
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (5, 6, 7))


def test_chat_round_trip(spark):
    rows = [(-2, 0, "sy|st\\p[INST]", "a\\b\\\\</s>|x[["), (-2, 1, "user", "[INST] [ [/INST]<s>\n"), (-2, 1, None, None), (-2, 2, "assistant", "\\</s>\\"), (-3, None, "user", "u"), (-3, 4, "assistant", ""), (-3, 4, "assistant", ""), (None, 0, "user", "<|x|> 😀 </SYS>"), (-4, 0, "assistant", "<" * 2000 + "</s>" * 2000)]
    c = spark.read.parquet(f"{SF}/conversations.parquet").union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = defaultdict(list)
    for r in c.collect():
        want[r.conv_id].append((r.turn if r.turn is not None else -(10**9), r.role or "", r.text or ""))
    f = chat.format_chats(c.withColumn("turns", F.lit(1)))
    got = {r.conv_id: r for r in chat.chat_digests(f).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        said = "".join(f"{b}\n{t}\n" for _, b, t in sorted(v))
        learned = "".join(t for _, b, t in sorted(v) if b == "assistant")
        g = got[k]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(v), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[-3].state == "invalid" and not got[-2].valid
    assert chat.format_chats(c.limit(0)).count() == 0


def slow_contamination(docs, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(low))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[j : j + k])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if x := wins.get(tuple(w[j : j + k])):
                    ids |= x
                    hit.update(range(j, j + k))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "the of"), (901, ""), (902, None), (903, "same WORDS here"), (904, "same WORDS here"), (905, "word " * 20)], "item_id long, text string"))
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = decontaminate.contamination(table, items)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_contamination(rows, [tuple(r) for r in items.collect()])
    bad = {x[0] for x in slow_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()]) if x[-1]}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {r.doc_id for r in docs.collect()} - bad
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    x = spark.createDataFrame([(1, "a c b d"), (2, "a x x x x x x x b c"), (3, None)], "doc_id long, text string")
    c = decontaminate._classes(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), "item_id", "text", 13)
    index = decontaminate.build_index(x, c.select(F.explode("toks").alias("term")))
    assert [(r.doc_id, r.start, r.end) for r in decontaminate.proximity_matches(index, c).collect()] == [(1, 0, 2)]


PAGE = '<html><head><title>T</title></head><body><header>Head</header><nav><a href="/">Home</a></nav><div class="sidebar">Side bar text that is long enough to look like content of its own</div>{}<div id="comments"><p>A reader says that this is a long and interesting comment</p></div><form>Name <input></form><footer>Foot &copy;</footer></body></html>'


def test_main_text(spark):
    want = "Title\nFirst & long paragraph of the article, with many words in it.\nShort.\nThe last paragraph is long again, so that nobody takes it for a menu."
    body = "<h1>Title</h1><p>First &amp; long  <b>paragraph</b>\n of the article, with many words in it.<p>Short.<div class='ad'>Buy now, buy more, buy everything you can</div><p>The last paragraph is long again, so that nobody takes it for a menu.</p>"
    assert webtext.main_text(PAGE.format(f"<article>{body}</article>")) == want
    assert webtext.main_text(PAGE.format(f"<div class='post'>{body}</div>")) == want
    assert webtext.main_text(None) == webtext.main_text("") == webtext.main_text("<p></p><script>x</script>") == ""
    assert webtext.main_text("<p>just text") == "just text"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert webtext.extract(pages).filter("n_chars = 0").count() == 0 and webtext.extract(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (4, "u v", ""), (5, "x", "only"), (5, "x", "only"), (None, "n", "only"), (9, "y", "\r\n\r\nContent-Length: 3\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("d", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr)
    first = {"<p>é</p>": 1, "": 2, "only": 5, rows[-1][2]: 9}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first_id = first[h or ""]
        want.append((i, len(b), warc.payload_digest(b), "response" if i == first_id else "revisit", None if i == first_id else first_id))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    # a monolithic file becomes members that open by themselves
    import gzip
    import json
    import zlib

    raw = [warc.record(k, "u", b"x" * k * 1000, "response", None) for k in range(5)]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(raw)))
    assert warc.normalise(str(tmp_path / "a.gz"), str(tmp_path / "b.gz")) == 5
    data = (tmp_path / "b.gz").read_bytes()
    index = [json.loads(x) for x in (tmp_path / "b.gz.idx").read_text().splitlines()]
    assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == raw and gzip.decompress(data) == b"".join(raw)


def slow_simhash(t):
    ws = (t or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    n = [sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(grams))


def slow_components(fps, bits=4):
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= bits
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(a))])
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, docs, odd, empty):
    for t in [None, "", "a", "A b", "a b c d e f", "x " * 1000]:
        assert simhash.simhash(t) == slow_simhash(t)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()][:120]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i].fingerprint == f"{slow_simhash(t):016x}" for i, t in rows)
    ids = sorted(got)
    label = slow_components([int(got[i].fingerprint, 16) for i in ids])
    assert all(got[i].component_id == ids[label[k]] for k, i in enumerate(ids))
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == len(ODD) and {x.component_id for x in r if x.doc_id in (1, 2, 3)} == {1} and {x.component_id for x in r if x.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(x.doc_id for x in simhash.keep_one(odd).filter("doc_id < 6").collect()) == [1, 4]


def test_near_copies_by_brute_force(spark):
    """No wrong link, every exact copy, and nearly all edited ones; each way to fetch the texts gives the same rows."""
    import random

    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(120))) for k in range(60)]
    for k in range(60, 160):  # copies with up to two other words, copies of those, and exact ones
        t = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one two"), (204, "One  two"), (204, "One  two"), (None, rows[0][1]), (2**60 + 1, rows[1][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("h", "fp", "t", "rep", "n")})
    sets = [set(simhash._shingles(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(20):
        for a, b in itertools.combinations(range(len(rows)), 2):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                label[a] = label[b] = min(label[a], label[b])
    group = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        group[label[k]].append(i)
    least = {i: min(x for x in group[label[k]] if x is not None) for k, (i, _) in enumerate(rows)}
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()), key=repr)
    assert len(got) == len(rows) and {i for i, _ in got} == {i for i, _ in rows}
    assert all(least[c] == least[i] for i, c in got)
    assert {c for i, c in got if i in (200, 201, 202)} == {200} and {c for i, c in got if i in (203, 204)} == {203}
    merged = [i for i, c in least.items() if i != c]
    assert len(merged) > 60 and sum(c != i for i, c in dict(got).items() if i in merged) >= 0.9 * len(merged)


def test_forest_finds_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:300].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, np.uint64(5) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    label = slow_components(fps)
    for kw in ({"leaf_rows": 16}, {"leaf_rows": 64, "split_rows": 40}):
        edges = simhash.link_fingerprints(df, **kw)
        at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
        own = np.arange(len(fps))
        for r in edges.collect():
            a, b = at[r.src], at[r.dst]
            while own[a] != a:
                a = own[a]
            while own[b] != b:
                b = own[b]
            own[max(a, b)] = min(a, b)
        for k in range(len(own)):
            while own[k] != own[own[k]]:
                own[k] = own[own[k]]
        assert (own == label).all()


def test_mix(spark, docs, odd, empty):
    m = mixing.mixed_documents(docs).toPandas()
    again = mixing.mixed_documents(docs).toPandas()
    assert m.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist() and (m.taken <= 3 * m["size"]).all()
    g = m.groupby("source").agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"))
    assert np.isclose(g.t.sum(), g.s.sum()) and (g.t <= 3 * g.s + 1e-6).all() and ((g.k - g.t).abs() <= 65).all()
    assert [r.x for r in spark.range(37).select(mixing.permuted(F.col("id"), F.lit(37).cast("long"), 16, F.lit(1)).alias("x")).orderBy("x").collect()] == list(range(37))
    r = mixing.mixed_documents(odd).collect()
    assert len(r) == len(ODD) and all(x["size"] == 0 and x.taken == 0 for x in r if x.doc_id in (1, 2, 3))
    assert mixing.mixed_documents(empty).count() == 0


def test_taken_by_brute_force(spark):
    """What each document gives, counted slot by slot and word by word."""
    rows = [(k, " ".join(["w"] * (k * 37 % 211)), None if k % 7 == 0 else f"s{k % 3}") for k in range(120)] + [(5, "w " * 40, "s2"), (500, None, "tiny"), (501, "one two", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed, plan, slots = mixing.mix(docs, 16)
    quota = {r.source: (r.blocks, r.slots) for r in plan.collect()}
    times, seen = defaultdict(int), defaultdict(set)
    for r in slots.collect():
        times[r.source, r.block] += 1
        assert 0 <= r.block < quota[r.source][0] and r.block not in seen[r.source, r.round]  # a round takes a block once
        seen[r.source, r.round].add(r.block)
    assert all(sum(n for (s, _), n in times.items() if s == source) == n_slots for source, (_, n_slots) in quota.items())
    owner, want = {}, defaultdict(list)
    for r in packed.collect():
        for w in range(r.start, r.start + r.size):
            assert (r.source, w) not in owner  # streams have no gaps and no overlaps
            owner[r.source, w] = (r.doc_id, r.start)
    given = defaultdict(int)
    for (source, w), at in owner.items():
        given[source, at] += times[source, w // 16]
    for r in packed.collect():
        want[r.doc_id].append((r.size, given[r.source, (r.doc_id, r.start)]))
    got = defaultdict(list)
    for r in mixing.mixed_documents(docs, 16).collect():
        got[r.doc_id].append((r.size, r.taken))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got) == 122


def test_targets(spark):
    df = spark.createDataFrame([("b", 100), ("a", 1), ("c", 1000), (None, 10), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    size = {"a": 1, "b": 100, "c": 1000, "d": 0, None: 10}
    weight = dict(zip(["a", "b", "c", "d", None], itertools.cycle([1, 2, 3])))
    want, left = {}, dict(weight)
    while left:  # share by weight; what is over a cap is shared anew
        rest = 1111 - sum(want.values())
        share = {k: rest * w / sum(left.values()) for k, w in left.items()}
        over = [k for k in left if share[k] > 3 * size[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3 * size[k]
            del left[k]
    assert all(np.isclose(got[k], want[k]) for k in size)
