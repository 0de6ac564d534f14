"""Scripts and languages that the most frequent characters of all trusted text leave out."""

import random

from lumenarc.llm import quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    latin = [chr(c) for c in range(33, 127)] + [" "]
    han = [chr(0x4E00 + k) for k in range(300)]
    words = {"el": ["".join(rng.choice("αβγδεζηθικλμ") for _ in range(5)) for _ in range(30)], "zh": ["".join(rng.choice(han) for _ in range(3)) for _ in range(120)]}
    docs, labels = [], []
    for k in range(80):
        docs.append((k, "".join(rng.choice(latin) for _ in range(4000)), "en"))
    for lang in ("el", "zh"):
        for _ in range(40):
            docs.append((len(docs), " ".join(rng.choice(words[lang]) for _ in range(60)), lang))
    labels = [(d[0], 1, 0) for d in docs]
    probes = {}
    for lang, letters in (("el", "αβγδεζηθικλμ"), ("zh", han)):
        probes[lang] = (len(docs), len(docs) + 1)
        docs.append((len(docs), " ".join(rng.choice(words[lang]) for _ in range(60)), lang))
        docs.append((len(docs), " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)), lang))
    return [(i, t, v, "s", len(t)) for i, t, v in docs], labels, probes


def test_scripts(spark):
    rows, labels, probes = corpus()
    docs = spark.createDataFrame([*rows, rows[-1], (None, *rows[-1][1:])], DOC)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == len(rows) + 2
    for lang, (clean, junk) in probes.items():
        a, b = (got[got.doc_id == i].iloc[0] for i in (clean, junk))
        assert a.lang_model == b.lang_model == lang and a.keep and not b.keep, lang


def test_short_trusted_texts_set_a_threshold(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(6)), "xx", "s", 0) for k in range(60)]
    rows += [(100, " ".join(rng.choice(words) for _ in range(60)), "xx", "s", 0), (101, "".join(rng.choice("qrstuvwxyz!?") for _ in range(300)), "xx", "s", 0)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, DOC), labels).collect()}
    assert got[100].keep and not got[101].keep and got[101].threshold is not None
