"""The near-duplicate stage finds every link, by brute force."""

import itertools
import random

from lumenarc.llm import simhash


def test_every_link_is_found(spark, monkeypatch):
    """Edits up to the threshold and beyond, a passage that all share, a large group of near copies, short texts."""
    monkeypatch.setattr(simhash, "COMMON", 3)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(words[:40])
    base = [[rng.choice(words) for _ in range(rng.choice((12, 60, 150)))] for _ in range(40)]
    rows = [" ".join(t) for t in base]
    for k in range(260):
        t = list(base[0] if k % 2 else rng.choice(base))
        for _ in range(rng.randrange(1 + len(t) // 25)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if k % 5 == 0:
            t = t[: len(t) - rng.randrange(1 + len(t) // 5)]
        rows.append(" ".join(t) + (" " + passage if k % 7 == 0 else ""))
    rows += ["", "one two", "One two", "one", None, passage, passage + " x", *rows[:5]]
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    links = [(a, b) for a, b in itertools.combinations(label, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(rows)):
        was = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == was:
            break
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) < len(rows) - 80


def test_only_texts_that_may_be_alike_are_moved_whole(spark, monkeypatch):
    """Texts that share a line and little else are candidates, but their sets of shingles stay where they are."""
    monkeypatch.setattr(simhash, "COMMON", 10_000)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(words[:9])
    rows = [" ".join([line, *rng.choices(words, k=rng.choice((3, 40, 300)))]) for _ in range(80)]
    rows += [rows[k] + " more" for k in range(0, 80, 4)]
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in rows]
    alike = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    moved, whole = [], simhash._alike

    def spy(pairs, *rest):
        moved.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(simhash, "_alike", spy)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert all(got[a] == got[b] for a, b in alike) and len(set(got.values())) == 80
    assert 0 < sum(moved) <= 2 * len(alike)


def test_rows_of_a_group_of_near_copies_grow_with_it(spark, monkeypatch):
    """Copies with a few other words each, most pairs of which are just not alike: no table has a row for each pair."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    base = words[:150]
    rows = []
    for k in range(480):
        t = list(base)
        for at in rng.sample(range(150), 1 + k % 5):
            t[at] = rng.choice(words)
        rows.append(" ".join(t))
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(146)} for t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = list(range(len(rows)))
    was = None
    while label != was:
        was = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    made, write = {}, simhash.materialize

    def spy(df, name):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", spy)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == dict(enumerate(label))
    assert 100 < len(set(label)) < len(rows) - 100 and max(made.values()) <= 31 * len(rows), made
    # classes cut into many blocks give the same
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 60)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == dict(enumerate(label))
