"""Stems against the algorithm's published examples; prices and clusters against values worked out by hand."""

from lumenarc.functions.stem import stem, stems
from lumenarc.operators import clusters, costs

#: Examples published with the algorithm, step by step.
EXAMPLES = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "predication": "predic", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "goodness": "good", "revival": "reviv", "allowance": "allow", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}


def test_stems(spark):
    assert {w: stem(w) for w in EXAMPLES} == EXAMPLES
    assert [stem(w) for w in ("", "is", "naïve", "x2s")] == ["", "is", "naïve", "x2s"]
    rows = spark.createDataFrame([("Running",), ("running",), (None,), ("runs",)], "term string")
    assert {tuple(x) for x in stems(rows).collect()} == {("running", "run"), ("runs", "run")}


def test_costs(spark):
    rows = spark.createDataFrame([("m", 1_000_000, 0), ("m-large-2", 0, 500_000), ("other", 10, 10), (None, None, 5)], "model string, input_tokens long, output_tokens long")
    got = [x.cost_usd for x in costs.token_costs(rows, {"m": (1.0, 2.0), "m-large": (3.0, 8.0)}, (0.0, 0.0)).collect()]
    assert got == [1.0, 4.0, 0.0, 0.0]
    assert tuple(costs.estimate(rows, 0.5).first()) == (4, 2.0)


def test_kmeans(spark):
    rows = spark.createDataFrame([(k, [float(k // 4 * 100), float(k % 4)]) for k in range(8)] + [(8, None), (9, [])], "id long, v array<double>")
    got = {x.id: x.cluster for x in clusters.kmeans(rows, "id", "v").collect()}
    assert set(got) == set(range(8)) and len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(4, 8)}) == 1 and got[0] != got[4]
    assert [tuple(x) for x in clusters.kmeans(rows.filter("id = 1"), "id", "v").collect()] == [(1, 0)]
