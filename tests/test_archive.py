"""Operators that SQL can't check, and answers that were once wrong, on small fixtures."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import answers, pii, scoring
from lumenarc.operators import chains, conversations, embed, entities, index, insights, runs, search, segments
from lumenarc.sources import exports, stores

DAY = datetime.datetime(2024, 1, 1)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


# Exports


def chat(k):
    return {"uuid": f"c{k}", "name": f"Chat {k}", "created_at": "2024-01-02T03:04:05Z", "chat_messages": [{"sender": "human", "text": f"hello {k}"}, {"sender": "assistant", "text": "hi"}]}


@pytest.mark.parametrize("write", [
    lambda rows: "\n".join(json.dumps(r) for r in rows) + "\n", lambda rows: json.dumps(rows), lambda rows: json.dumps(rows, indent=1),
    lambda rows: "\n".join(json.dumps(r | {"pad": "x" * 80_000}) for r in rows),
])
def test_every_conversation_of_an_export_is_read(spark, tmp_path, write):
    (tmp_path / "e.json").write_text(write([chat(k) for k in range(5)]))
    got = exports.read_export(spark, str(tmp_path / "e.json"), "claude").collect()
    assert sorted(r.external_id for r in got) == [f"c{k}" for k in range(5)]
    assert all([m.role for m in r.messages] == ["user", "assistant"] and r.created_at is not None for r in got)


def test_one_indented_conversation(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(chat(1), indent=2))
    assert exports.read_export(spark, str(tmp_path / "e.json"), "claude").count() == 1


def test_formats_have_one_schema(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><b>You:</b> question <b>Gemini:</b> answer</html>")
    (tmp_path / "b.json").write_text(json.dumps([chat(1)]))
    a, b = (exports.read_export(spark, str(tmp_path / n), "gemini") for n in ("a.html", "b.json"))
    assert a.unionByName(b).count() == 2


# Personal data


@pytest.mark.parametrize(("kind", "value", "shown"), [
    ("email", "ab@x.org", "**@x.org"), ("email", "a@x.org", "*@x.org"), ("email", "john@example.com", "jo**@example.com"), ("ssn", "123-45-6789", "***-**-6789"), ("ip_address", "8.8.4.4", "8.***.***.*"),
    ("credit_card", "4111-1111-1111-1111", "************1111"), ("phone", "555-123-4567", "******4567"), ("api_key", "sk-abcdef", "sk*****ef"), ("mac_address", "abc", "***"),
])
def test_masks(kind, value, shown):
    assert pii.MODES["mask"](kind, value) == shown


@pytest.mark.parametrize(("text", "found"), [
    ("at 255.1.2.3 or 8.8.8.8", ["8.8.8.8"]), ("at 172.16.0.1", ["172.16.0.1"]), ("at 169.254.1.1", ["169.254.1.1"]), ("192.168.1.100, 10.0.0.1, 127.0.0.1, 0.0.0.0", []),
])
def test_addresses(text, found):
    assert [m[3] for m in pii.find(text, ["ip_address"])] == found


def test_severities():
    level = {n: s for n, _, s, _ in pii.P.PII}
    assert level == {"email": 2, "phone": 2, "ssn": 3, "credit_card": 3, "api_key": 4, "aws_key": 4, "ip_address": 1, "mac_address": 1, "iban": 3, "date_of_birth": 2}
    # of two that overlap, the more severe one stays
    text = "api_key=4111111111111111abcdef"
    assert [m[0] for m in pii.find(text, ["api_key", "credit_card", "phone"])] == ["api_key"]


def test_scrub_by_brute_force(spark):
    texts = ["mail ann@x.org or 555-123-4567", None, "", "card 4111 1111 1111 1111 and 8.8.8.8", "mail ann@x.org or 555-123-4567", "x" * 30_000 + " ann@x.org"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, matched int")
    for mode in ("redact", "hash", "remove", "tokenize"):
        got = sorted((r.text or "", r.scrubbed or "") for r in pii.scrub(df, mode=mode).collect())
        want = []
        for t in texts:
            out = t or ""
            for kind, a, b, v, _, _ in reversed(pii.find(t or "", pii.P.PII_DEFAULT)):
                name = {"redact": f"[REDACTED-{kind.upper().replace('_', '-')}]", "hash": f"[{kind.upper()}-{hashlib.sha256(v.encode()).hexdigest()[:12]}]", "remove": "", "tokenize": f"[{kind.upper()}-{hashlib.md5(v.encode()).hexdigest()[:8]}]"}[mode]
                out = out[:a] + name + out[b:]
            want.append((t or "", out))
        assert got == sorted(want)
    assert [r.t for r in df.select(pii.types_found(F.col("text")).alias("t")).collect()][0] == ["email", "phone"]
    kept = pii.vault(pii.scrub(df, mode="tokenize"))
    assert pii.forget(kept, kept.filter("type = 'email'")).filter("type = 'email'").count() == 0 and kept.count() > 1


# Scores


def test_equal_rows_do_not_count_twice(spark):
    rows = [("python and docker",), ("python and docker",), ("python here",), ("python there",)]
    got = scoring.score_all(spark.createDataFrame(rows, "text string")).collect()
    # docker stands in two rows, python in four: one rare term in each of the first two
    assert sorted((r.text, r.uniqueness) for r in got) == sorted([(rows[0][0], 60), (rows[0][0], 60), ("python here", 50), ("python there", 50)])


def test_percentiles_of_many_values(spark):
    df = spark.createDataFrame([(v,) for v in [50, 50, 70, 90]], "v int")
    assert sorted((r.v, r.percentile) for r in scoring.percentiles(df, "v").collect()) == [(50, 25), (50, 25), (70, 75), (90, 100)]
    many = spark.range(500).select((F.col("id") * 7 % 500).alias("v"))
    assert sorted(r.percentile for r in scoring.percentiles(many, "v").collect()) == pytest.approx([100 * (k + 1) / 500 for k in range(500)])


def test_verdict(spark):
    say = lambda **s: one(spark, scoring.verdict({k: F.lit(v) for k, v in s.items()}), a=1)
    assert say(technical_depth=80, clarity=75, uniqueness=90) == "strong in technical depth and clarity"
    assert say(technical_depth=80, clarity=40) == "strong in technical depth; weak in clarity" and say(clarity=50) == "balanced"


# Search


def test_stems_and_marks_on_the_index(spark):
    rows = [("1", "Reading Zürich", ["café"]), ("2", "read it, reader", []), ("3", None, None), ("4", "of the reading", ["x"]), (None, "reading", [])]
    df = spark.createDataFrame(rows, "id string, title string, tags array<string>")
    idx = index.build(df, "id", ["title", "tags"])
    ask = lambda q, every=True: sorted(r.doc for r in index.score(spark, idx, search.parse(q), {"title": 1.0, "tags": 1.0}, every).collect())
    assert ask("+reads") == ["1", "2", "4"] and ask("+cafe") == ["1"] and ask('"zurich"') == ["1"]
    assert ask('"the reading"') == ["4"] and ask('"reading the"') == [] and ask("+reading -cafe") == ["2", "4"]
    assert ask("zu ca", every=False) == ["1"] and ask("nothing") == []
    assert [r.term for r in index.nearly(spark, idx, "caffe").collect()] == ["cafe"]
    assert sorted(r.n for r in spark.read.parquet(f"{idx.path}/totals").collect()) == [4]


def test_search_call(spark):
    rows = [(k, "same words here", f"2024-01-{k + 1:02}", k % 2, ["Py"] if k < 3 else []) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, title string, ts string, source long, tags array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    idx = index.build(df, "id", ["title"])
    find = lambda q, f=conversations.Filters(), page=1: [(r["rank"], r.total, r.id) for r in conversations.find(spark, idx, df, "id", q, f, {"title": 1.0}, page, 10, ts="ts").collect()]
    first, second = find("words"), find("words", page=2)
    assert [x[2] for x in first + second] == list(range(20)) and {x[1] for x in first} == {20} and second[0][0] == 11
    assert [x[2] for x in find("words tag:py")] == [0, 1, 2] and [x[2] for x in find("tag:PY")] == [2, 1, 0]
    assert [x[2] for x in find("", conversations.Filters(source=1, date_from="2024-01-10", date_to="2024-01-14"))] == [13, 11, 9]
    assert find("absent") == [] and [x[2] for x in find("-same")] == []
    with pytest.raises(ValueError):
        conversations.hybrid_score(df, df, "other", 3)


def test_refreshed_index_equals_a_new_one(spark):
    old = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "id long, t string")
    new = spark.createDataFrame([(2, "a a"), (4, "b")], "id long, t string")
    idx = index.refresh(spark, index.build(old, "id", ["t"], stemmed=False), new, "id", ["t"], spark.createDataFrame([(3,)], "doc long"))
    whole = index.build(old.filter("id = 1").union(new), "id", ["t"], stemmed=False)
    rows = lambda i, part: sorted(tuple(map(str, r)) for r in spark.read.parquet(f"{i.path}/{part}").collect())
    assert all(rows(idx, p) == rows(whole, p) for p in ("postings", "docs", "totals"))


# Insights, runs


def test_insights(spark):
    rows = [(DAY + datetime.timedelta(days=k // 2), "a" if k else "b", k % 10 != 0, k % 3 == 0, 50 if k else 1, ["py"], "web") for k in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, source string, code boolean, err boolean, score int, langs array<string>, dom string")
    rising = spark.createDataFrame([("rust", 9, 80.0), ("perl", 4, -50.0), ("java", 3, 10.0)], "name string, n long, growth double")
    got = {r.id: r for r in insights.insights(df, "ts", "source", F.col("code"), F.col("err"), F.col("score"), F.col("langs"), F.col("dom"), rising).collect()}
    assert set(got) == {"summary_overview", "top_technologies", "top_domains", "trend_rust", "decline_perl", "high_debug_rate", "code_heavy", "source_dominance", "quality_outliers"}
    assert got["summary_overview"].description == "40 conversations, 36 with code (90%)" and got["trend_rust"].score == pytest.approx(0.9) and got["quality_outliers"].description.startswith("1 ")
    assert insights.insights(df.limit(0), "ts", "source", F.col("code"), F.col("err"), F.col("score"), F.col("langs"), F.col("dom")).count() == 0


def test_smoothed_and_labels(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 0.0), ("b", 1, 5.0)], "k string, o int, v double")
    assert {r.k: r["mean"] for r in runs.smoothed(df, "o", "v", ["k"]).collect()} == pytest.approx({"a": 0.7 * (0.7 * 10 + 0.3 * 20), "b": 5.0})
    things = spark.createDataFrame([(1, "term", "sql"), (2, "lang", "python"), (3, "tag", "web dev")], "id long, kind string, name string")
    cl = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (-1, 5)], "cluster int, id long")
    assert {r.cluster: r.label for r in insights.cluster_labels(cl, things, id_col="id").collect()} == {0: "Sql", 1: "Python Development", 2: "Web Dev", 3: "Cluster 3", -1: "Miscellaneous"}


def test_manifest_and_backups(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    was = spark.createDataFrame(runs.manifest(spark, str(tmp_path)).collect())
    (tmp_path / "a.txt").write_text("one and more")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    now = runs.manifest(spark, str(tmp_path))
    assert {r.path[-5:]: r.change for r in runs.changes(was, now).collect()} == {"a.txt": "new_content", "b.txt": "missing", "c.txt": "new"}
    assert {r.path[-5:]: r.problem for r in runs.damaged(was, now).collect()} == {"a.txt": "altered", "b.txt": "missing"}
    stats = stores.file_stats(spark, str(tmp_path), "text").first()
    assert (stats.files, stats.bytes, stats["rows"]) == (2, 15, 2)


# Entities, chains, projects, segments


def test_entities_and_chains(spark):
    text = "Continuing from my last go at it: C++ and KeyError: x in src/app.py"
    rows = spark.createDataFrame([(1, "python and docker", DAY), (2, text, DAY + datetime.timedelta(hours=3)), (3, "python and docker", DAY + datetime.timedelta(hours=20)), (4, "python", DAY + datetime.timedelta(days=9)), (5, None, None)], "id long, t string, ts timestamp")
    found = entities.extract(rows, "id", "t")
    assert {(r.kind, r.name) for r in found.filter("id = 2").collect()} == {("technology", "go"), ("error", "keyerror"), ("file", "src/app.py")}
    names = found.filter("kind = 'technology'").union(spark.createDataFrame([(2, "technology", "python", True)], found.schema))
    got = chains.detect(rows, names, "id", "ts", "t", "name").collect()
    assert [(r.kind, r.members, r.confidence, sorted(r.shared), r.hours) for r in got] == [("continuation", ["1", "2", "3"], 0.9, ["docker", "python"], 20.0)]
    near = chains.related(rows, names, 1, "id", "ts", "name").collect()
    assert [(r.id, r.shared, r.relation) for r in near][0] == (3, 2, "follow_up")
    nodes, edges = entities.build(found, "id")
    assert [(r.a, r.b, r.groups) for r in edges.collect() if r.groups > 1] == [("docker", "python", 2)]
    assert {r.name: r.kind for r in entities.resolve(nodes.union(nodes.withColumn("kind", F.lit("file")))).collect()}["python"] == "technology"


def test_projects(spark):
    rows = [(1, "see /home/ann/shop/src/a.py and github.com/ann/shop"), (2, "in /home/ann/shop/b.py with docker and k8s"), (3, "project called shop here, /home/ann/shop/c.js"), (4, "nothing"), (5, None)]
    got = chains.projects(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert [(r.name, r.members, r.roots, r.confidence) for r in got] == [("shop", [1, 2, 3], ["/home/ann/shop", "git:ann/shop", "repo:shop"], 0.9)]


def test_segments(spark):
    long = "python pytest assert and more words to be long enough for a segment of its own, so that it does not join the one before. "
    rows = [(1, 0, "user", long * 2), (1, 1, "user", "By the way, docker container and dockerfile. " + "words and words " * 12), (2, 0, "user", "How are you?")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in segments.topics(segments.described(turns)).collect()}
    assert got[1].topic_count == 2 and got[1].summary.startswith("Multi-topic conversation: ") and got[2].flow == ["Question & Answer"] and got[2].summary == "Single topic: Question & Answer"
    raw = spark.createDataFrame([(1, "Human: a\nmore\nAssistant: b\nAI: \nUser: c"), (2, "no roles"), (3, None)], "conv_id long, raw string")
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in segments.turns_of(raw, "raw").collect()) == [(1, 0, "user", "a\nmore"), (1, 1, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "user", "no roles")]


# Answers


def test_answers(spark):
    text = "SUMMARY\nDOMAIN: Web\n TAGS: a, py, docker , " + "x" * 60 + "\nTOPICS: t\nINSIGHTS:\n- one\n• two\nSTATUS: Done\nFUTURE VALUE: much\nof it\nNEXT STEPS: go"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(*answers.tags_answer(F.col("t")), *answers.insights_answer(F.col("t"))).first()
    assert (r.primary_domain, r.tags, r.key_topics, r.key_insights, r.status, r.value_proposition, r.next_steps) == ("Web", ["py", "docker"], ["t"], ["one", "two"], "Done", "much of it", "go")
    r = spark.createDataFrame([("ABSTRACTIVE: short\nEXTRACTIVE: long",)], "t string").select(*answers.summary_answer(F.col("t"))).first()
    assert (r.abstractive, r.extractive) == ("short", "long")
    assert one(spark, answers.clean_tags(F.col("t")), t="'python', \"ai\", [docker]") == ["python", "docker"] and one(spark, answers.clean_title(F.col("t")), t=' "A title" ') == "A title"
    assert one(spark, answers.duration_label(F.col("s")), s=7325.0) == "2h 2m" and one(spark, answers.size_label(F.col("s")), s=1536) == "1.5 KB" and one(spark, answers.masked_secret(F.col("s")), s="sk-123456789") == "****6789"
    d = one(spark, answers.diff({"a": (F.col("x"), F.col("y"), False), "b": (F.col("x"), F.col("x"), False)}), x="", y="new")
    assert [(r.field, r.change, r.new) for r in d] == [("a", "added", "new")]
    found = one(spark, answers.artifacts(F.col("t")), t="```bash\ndocker run --rm image:latest\n```\n```bash\ndocker run --rm image:latest\n```\n```\nsh\n```")
    assert [(r.type, r.language, r.content) for r in found] == [("shell_command", "bash", "docker run --rm image:latest")]


# Stores and vectors


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, None), ("b", "x")], "convo_id string, external_id string")
    got = [r.external_id for r in stores.with_external_ids(df).collect()]
    assert got[0] == "a" and got[1].startswith("conv_") and got[2] == "x"
    (tmp_path / "l.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2},\n {"a": 3}]')
    assert {r.path[-6:]: r.n for r in stores.count_conversations(spark, str(tmp_path)).collect()} == {"l.json": 2, "d.json": 3}
    run = {"run_id": "r", "started_at": "2024-01-01T00:00:00", "completed_at": "2024-01-01T01:00:00", "conversations_processed": 3, "conversations_failed": 1, "total_api_calls": 4, "total_tokens": 7, "total_cost_usd": 0.5}
    (tmp_path / "m.json").write_text(json.dumps({"total_cost": 0.5, "historical_runs": [run]}, indent=1))
    r = runs.run_metrics(stores.read_runs(spark, str(tmp_path / "m.json")).withColumn("failed_calls", F.lit(0))).first()
    assert (r.processed, r.input_tokens, r.success_rate) == (3, 3, 0.75)
    assert stores.repo_path(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    doc = {"entities": [{"id": "1", "name": "py", "type": "technology", "count": 2, "conversations": ["a"]}], "relationships": [{"source": "1", "target": "2", "type": "co_occurs", "weight": 2.0, "conversations": ["a"]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = entities.read_document(spark, str(tmp_path / "g.json"))
    entities.save(nodes, edges, str(tmp_path / "graph"))
    assert [x.count() for x in entities.load(spark, str(tmp_path / "graph"))] == [1, 1]


def test_vectors_of_texts(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red apple pie"), (3, "blue car"), (4, ""), (5, None)], "id long, t string")
    v = {r.id: r.embedding for r in embed.embed(df, "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert len(v[1]) == 384 and dot(1, 1) == pytest.approx(1, abs=1e-5) and dot(1, 2) > dot(1, 3) and sum(v[4]) == sum(v[5]) == 0
    pts = spark.createDataFrame([(k, [1.0, k / 100]) for k in range(4)] + [(9, [0.0, 1.0])], "id long, embedding array<double>")
    got = {r.id: r.cluster for r in embed.cluster(pts, "id", "embedding", "density", similarity=0.99).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: -1}
