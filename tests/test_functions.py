"""Fixtures with values worked out by hand."""

import json

from pyspark.sql import functions as F

from lumenarc.functions import pii, scoring, text as T
from lumenarc.operators import components, context, evaluate, graph, search, segments, tables, trends
from lumenarc.sources import exports


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


def test_query_language():
    q = search.parse('+required "exact phrase" regular -excluded tag:blue')
    assert (q.required, q.phrases, q.terms, q.excluded, q.tags) == (["required"], ["exact phrase"], ["regular"], ["excluded"], ["blue"])


def test_text_values(spark):
    code = "```py\na\n```\n```bash\nb\n```\n```\nc\n```"
    assert one(spark, T.code_languages(F.col("t")), t=code) == ["bash", "python"]
    assert one(spark, F.size(T.code_blocks(F.col("t"))), t=code) == 3
    assert one(spark, T.title(F.col("t")), t="x" * 101) == "x" * 97 + "..."
    assert one(spark, T.week_label(F.to_timestamp("t")), t="2024-12-30") == "2025-W01"
    assert one(spark, T.link_domains(F.col("t")), t="see http://b.org:80/x and https://a.com") == ["a.com", "b.org"]
    assert one(spark, T.terms(F.col("t")), t="SQL api sql unit test") == ["sql", "api", "unit test"]
    assert [one(spark, T.score_value(F.lit(v))) for v in (6.5, 7.5, None)] == [6, 8, 5]
    assert one(spark, T.when_said(F.col("t")), t="2025-01-02T03:04:05.000006") is not None


def test_scores(spark):
    grades = [one(spark, scoring.grade(F.lit(v))) for v in (95, 94, 87, 85, 75, 70, 65, 50, 45, 35, 34)]
    assert grades == ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F"]
    assert [one(spark, scoring.legacy(F.lit(v))) for v in (1, 5, 9)] == [0, 50, 100]
    got = scoring.percentiles(spark.createDataFrame([(50,), (50,), (70,), (90,)], "overall int"), "overall").orderBy("overall").collect()
    assert [float(r.percentile) for r in got] == [25, 25, 75, 100]


def test_pii(spark):
    find = lambda t: [(x[0], x[3]) for x in pii.find(t, pii.P.PII_DEFAULT)]
    assert find("mail john@example.com now") == [("email", "john@example.com")]
    assert find("192.168.1.100 10.0.0.1 8.8.8.8") == [("ip_address", "8.8.8.8")]
    assert ("credit_card", "4111-1111-1111-1111") in find("card 4111-1111-1111-1111")
    assert pii.MODES["mask"]("email", "john@example.com") == "jo**@example.com"
    df = spark.createDataFrame([("a john@example.com b",), (None,)], "text string")
    got = [r.scrubbed for r in pii.scrub(df).collect()]
    assert got == ["a [REDACTED-EMAIL] b", None]
    again = [r.x for r in pii.scrub(spark.createDataFrame([(got[0],)], "text string")).select(F.col("scrubbed").alias("x")).collect()]
    assert again == got[:1]


def test_fusion(spark):
    a = spark.createDataFrame([("A", 2.0), ("B", 1.0)], "id string, score double")
    b = spark.createDataFrame([("B", 2.0), ("C", 1.0)], "id string, score double")
    got = [(r.id, round(r.score, 9)) for r in search.rrf(a, b, "id").collect()]
    assert got == [("B", round(0.5 / 62 + 0.5 / 61, 9)), ("A", round(0.5 / 61, 9)), ("C", round(0.5 / 62, 9))]


def test_trends(spark):
    def growth(values):
        df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, period int, n int")
        r = trends.growth(df, ["k"]).first()
        return r.early, r.late, r.growth, r.direction

    assert growth([2, 2, 4, 6]) == (2, 5, 150, "rising")
    assert growth([1, 2, 3]) == (1, 2.5, 150, "rising")
    assert growth([0, 0, 3]) == (0, 1.5, 100, "rising")


def test_evaluation(spark):
    f = evaluate.feedback(spark.createDataFrame([("a", 1)] * 7 + [("a", -1)] * 3, "k string, v int"), ["k"], F.col("v")).first()
    assert (f.total, f.positive, f.negative, f.satisfaction, f.status) == (10, 7, 3, 0.7, "healthy")
    r = evaluate.ranked(spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "s int, p int, c boolean"), "s", "p", "c").first()
    assert abs(r.precision - 1 / 3) < 1e-9 and r.mrr == 0.5 and abs(r.ndcg - 0.6309) < 1e-4


def test_graph(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "g int, e string")
    e = graph.edges(rows, "g", "e")
    assert {(r.a, r.b): r.weight for r in e.collect()} == {("a", "b"): 3.0, ("a", "c"): 2.0, ("b", "c"): 2.0}
    assert [r.path for r in graph.paths(e, "a", "c").collect()] == [["a", "c"], ["a", "b", "c"]]
    c = components.connected_components(spark.createDataFrame([(5, 4), (4, 9), (7, 8), (None, 3), (6, 6)], "src int, dst int"))
    assert {r.node: r.root for r in c.collect()} == {4: 4, 5: 4, 9: 4, 7: 7, 8: 7, 6: 6}
    assert components.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_pairs(spark):
    rows = spark.createDataFrame([(1, "2025-01-01 00:00:00", x) for x in "abc"] + [(2, "2025-01-01 10:00:00", x) for x in "abc"] + [(3, "2025-01-03 00:00:00", "a")], "id int, ts string, e string").withColumn("ts", F.to_timestamp("ts"))
    got = context.band_pairs(rows, "id", "ts", "e", 24).collect()
    assert [(r.a, r.b, r.shared, r.hours_apart) for r in got] == [(1, 2, 3, 10.0)]
    assert one(spark, context.related_score(F.lit(1), F.lit(6))) == 0.875 and one(spark, context.follow_up_confidence(F.lit(3))) == 0.8


def test_segments_cover_all_turns(spark):
    t = spark.createDataFrame([(1, 0, "python " * 30), (1, 1, "docker container " * 20), (1, 2, "by the way"), (1, 3, "x" * 200)], "conv_id int, turn int, text string")
    got = segments.segments(t).orderBy("segment").collect()
    assert sum(r.n_turns for r in got) == 4 and got[0].first_turn == 0 and len(got) >= 2


def test_tables(spark):
    old, new = (spark.createDataFrame(x, "id int, v int") for x in ([(1, 1), (2, 2)], [(2, 3), (3, 4)]))
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [(1, 1), (2, 3), (3, 4)]
    assert [r.id for r in tables.unseen(new, old, ["id"]).collect()] == [3]


def test_exports(spark, tmp_path):
    node = lambda i, parent, kids, role=None, text=None: {"id": i, "parent": parent, "children": kids, "message": role and {"id": i, "author": {"role": role}, "content": {"parts": [text]}, "create_time": 1.7e9}}
    chat = {"id": "c1", "title": "T", "create_time": 1.7e9, "mapping": {"r": node("r", None, ["s"]), "s": node("s", "r", ["u"], "system", "no"), "u": node("u", "s", ["a", "b"], "user", "Hi"), "a": node("a", "u", [], "assistant", "A"), "b": node("b", "u", [], "assistant", "B")}}
    (tmp_path / "tree.json").write_text(json.dumps([chat, {"id": "c2", "title": "E", "mapping": {}}]))
    got = exports.read_export(spark, str(tmp_path / "tree.json"), "chatgpt").collect()
    assert [(r.source, r.external_id, [(m.role, m.text) for m in r.messages]) for r in got] == [("OpenAI", "c1", [("user", "Hi"), ("assistant", "A")])]
    (tmp_path / "linear.json").write_text(json.dumps([{"uuid": "x", "name": "N", "created_at": "2025-01-01T00:00:00Z", "chat_messages": [{"text": "q", "sender": "human"}, {"text": "", "sender": "human"}, {"text": "r", "sender": "assistant"}]}]))
    got = exports.read_export(spark, str(tmp_path / "linear.json"), "claude").first()
    assert got.source == "Anthropic" and [m.role for m in got.messages] == ["user", "assistant"] and got.created_at is not None
    (tmp_path / "t.html").write_text('<div class="outer-cell x">Prompted&nbsp;What is it?<br>Dec 1, 2025, 1:35:38 PM PST<br><p>An answer.</p></div>')
    got = exports.read_export(spark, str(tmp_path / "t.html"), "gemini").first()
    assert [(m.role, m.text) for m in got.messages] == [("user", "What is it?"), ("assistant", "An answer.")] and got.created_at.hour == 13
