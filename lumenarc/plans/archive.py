"""Queries of the archive's operators: search on an index, filters, statistics, runs, entities, chains, answers, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import answers as A, pii, scoring
from ..operators import chains, conversations as C, embed, entities, index as I, insights, runs, search as S, segments, vectors as V
from ..sources import stores
from .registry import query

# Search on a written index

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_LEN = f"len(coalesce({TOKENS.format('text')}, [])) + len(coalesce({TOKENS.format('source')}, []))"


def _tf(test: str) -> str:
    """Weighted occurrences of the tokens x that pass a test, text once and source five times."""
    return f"(len(list_filter(coalesce({TOKENS.format('text')}, []), lambda x: {test})) + 5 * len(list_filter(coalesce({TOKENS.format('source')}, []), lambda x: {test})))::DOUBLE"


def _phrase(*words: str) -> str:
    """Occurrences of adjacent tokens in text."""
    toks = f"coalesce({TOKENS.format('text')}, [])"
    test = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"(SELECT count(*) FROM (SELECT {toks} AS t), range(1, len(t) + 1) r(i) WHERE {test})::DOUBLE"


def _ranked(parts: list[str], banned: str | None = None, where: str = "true") -> str:
    """The BM25 of documents that have every part."""
    cols = ", ".join(f"{p} AS t{k}" for k, p in enumerate(parts))
    seen = ", ".join(f"count(*) FILTER (t{k} > 0) AS d{k}" for k in range(len(parts)))
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * l / av))" for k in range(len(parts)))
    all_ = " AND ".join(f"t{k} > 0" for k in range(len(parts)))
    ban = f"{_tf(banned)} AS ban" if banned else "0 AS ban"
    return f"""r AS (SELECT doc_id, lang, source, n_chars, {_LEN} AS l, {cols}, {ban} FROM documents),
      s AS (SELECT count(*) AS n, avg(l) AS av, {seen} FROM r),
      m AS (SELECT doc_id, {score} AS score FROM r, s WHERE {all_} AND ban = 0 AND {where})"""


_WEIGHTS = {"text": 1.0, "source": 5.0}


def _index(read) -> tuple[DataFrame, I.Index]:
    docs = read("documents")
    return docs, I.build(docs, "doc_id", ["text", "source"], stemmed=False)


def _page(docs: DataFrame, idx: I.Index, q: str, f: C.Filters = C.Filters(), **kw) -> DataFrame:
    named = docs.withColumnRenamed("lang", "primary_domain")
    out = C.find(docs.sparkSession, idx, named, "doc_id", q, f, _WEIGHTS, ts="n_chars", score="n_chars", **kw)
    return out.select("rank", "total", "doc_id", F.round("relevance", 6).alias("relevance"))


_STARTS_TH, _AND, _WAS = "starts_with(x, 'th')", "x = 'and'", "x = 'was'"


@query(f"WITH {_ranked([_tf(_STARTS_TH), _tf(_AND), _phrase('of', 'the')], _WAS)} SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, (SELECT count(*) FROM m) AS total, doc_id, round(score, 6) AS relevance FROM m ORDER BY score DESC, doc_id LIMIT 50")
def search_page(read):
    """Prefix, required term, phrase and exclusion in one query."""
    docs, idx = _index(read)
    return _page(docs, idx, 'th +and "of the" -was')


@query(f"WITH {_ranked([_tf(_AND)], None, "lang = 'en' AND n_chars >= 500 AND n_chars <= 5000")} SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, (SELECT count(*) FROM m) AS total, doc_id, round(score, 6) AS relevance FROM m) WHERE rank > 20 AND rank <= 40")
def search_filtered_second_page(read):
    docs, idx = _index(read)
    return _page(docs, idx, "+and", C.Filters(domain="en", min_score=500, max_score=5000), page=2, size=20)


@query("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank, count(*) OVER () AS total, doc_id, 0.0::DOUBLE AS relevance FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 50")
def search_without_words(read):
    docs, idx = _index(read)
    return _page(docs, idx, "", C.Filters(source="src1"))


@query(f"WITH {_ranked([_tf(_AND)])} SELECT doc_id FROM m")
def search_after_refresh(read):
    """An index of other texts, brought up to date: half of the documents had no text, a few others are gone."""
    docs = read("documents")
    stale = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("and stale")).otherwise(F.col("text")))
    extra = docs.sparkSession.createDataFrame([(-1, "and gone", "x")], "doc_id long, text string, source string")
    idx = I.build(stale.select("doc_id", "text", "source").unionByName(extra), "doc_id", ["text", "source"], stemmed=False)
    idx = I.refresh(docs.sparkSession, idx, docs.filter("doc_id % 2 = 0"), "doc_id", ["text", "source"], extra.select(F.col("doc_id").alias("doc")))
    idx = I.compact(docs.sparkSession, idx, 2)
    return I.score(docs.sparkSession, idx, S.parse("+and"), _WEIGHTS).select(F.col("doc").alias("doc_id"))


@query()
def search_stemmed(read):
    docs = read("documents")
    idx = I.build(docs, "doc_id", ["text"])
    return I.score(docs.sparkSession, idx, S.parse("+reading"), {"text": 1.0}).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


_COS = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])))"
_NEAR = f"v AS (SELECT vec_id AS doc_id, {_COS} AS score FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 7) AS b FROM embeddings))"


@query(f"""WITH {_ranked([_tf(_AND)])}, {_NEAR}, x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM m), y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v)
  SELECT doc_id, round(coalesce(0.3 / (60 + x.r), 0) + coalesce(0.7 / (60 + y.r), 0), 9) AS score FROM (SELECT * FROM x WHERE r <= 60) x FULL JOIN (SELECT * FROM y WHERE r <= 60) y USING (doc_id)
  ORDER BY coalesce(0.3 / (60 + x.r), 0) + coalesce(0.7 / (60 + y.r), 0) DESC, x.r NULLS LAST, y.r NULLS LAST LIMIT 20""")
def search_hybrid(read):
    """BM25 and cosine of vectors, fused, in the mode that favours vectors."""
    docs, idx = _index(read)
    e = read("embeddings")
    words = I.score(docs.sparkSession, idx, S.parse("+and"), _WEIGHTS)
    one = e.filter("vec_id = 7").select(F.col("embedding").alias("_q"))
    near = e.join(F.broadcast(one)).select(F.col("vec_id").alias("doc"), V.cosine(F.col("embedding"), F.col("_q")).alias("score"))
    return C.hybrid_score(words, near, "semantic", 20).select(F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"))


@query(f"SELECT vec_id, label, round(similarity, 3) AS similarity FROM (SELECT vec_id, label, {_COS} AS similarity FROM (SELECT vec_id, label, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b FROM embeddings WHERE label = 3)) WHERE similarity >= 0.0 ORDER BY similarity DESC, vec_id LIMIT 10")
def semantic_search(read):
    e = read("embeddings")
    return C.semantic(e, e.filter("vec_id = 3"), "vec_id", "embedding", 10, C.Filters(source=3), least=0.0, source="label").select("vec_id", "label", "similarity")


# Filters and lists


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1994-02-01' AND o_orderdate < TIMESTAMP '1995-02-02' AND o_totalprice >= 50000 AND o_totalprice <= 150000 AND o_orderpriority = '1-URGENT'")
def filters_all(read):
    f = C.Filters("F", "1994-02-01", "1995-02-01", 50000, 150000, domain="1-URGENT")
    return read("orders").filter(C.condition(f, "o_orderstatus", "o_orderdate", "o_totalprice", domain="o_orderpriority")).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def filtered_count(read):
    return C.count(read("orders"), C.Filters(source="O"), source="o_orderstatus")


_TYPE_TAGS = "string_split(lower(p_type), ' ')"


@query(f"SELECT p_partkey FROM part WHERE list_has_any({_TYPE_TAGS}, ['steel', 'brass'])")
def tags_any(read):
    p = read("part").withColumn("tags", F.split("p_type", " "))
    return p.filter(C.condition(C.Filters(tags=("Steel", "BRASS")))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def text_in_any_field(read):
    p = read("part").withColumn("tags", F.split("p_type", " "))
    return C.with_text(p, "RED", ["p_name", "p_brand", "tags"]).select("p_partkey")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts)::DATE FROM events) AND ts < (SELECT min(ts)::DATE FROM events) + INTERVAL 3 DAY")
def dated_scan(read):
    e = read("events")
    first = e.agg(F.to_date(F.min("ts")).cast("string")).first()[0]
    last = e.agg(F.date_add(F.to_date(F.min("ts")), 2).cast("string")).first()[0]
    return C.dated(e, "ts", first, last).select("event_id")


@query("SELECT conv_id FROM (SELECT conv_id, sum(length(text)) AS n, count(*) AS m FROM conversations GROUP BY 1) WHERE n >= 400 AND m >= 4")
def enrichment_gate(read):
    rows = read("conversations").groupBy("conv_id").agg(F.concat_ws("", F.collect_list("text")).alias("t"), F.count("*").alias("m"))
    return rows.filter(C.worth_enriching(F.col("t"), F.col("m"), 400, 4)).select("conv_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND NOT regexp_matches(coalesce(text, ''), 'tion')")
def needs_tags(read):
    d = read("documents").withColumn("tags", F.when(F.col("text").rlike("tion"), F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")))
    return d.filter(C.needs_tags(F.col("tags"), F.col("source"), ["src1", "src2"])).select("doc_id")


@query("SELECT doc_id, list_filter(['text', 'lang', 'short'], lambda r: (r = 'text' AND (text IS NULL OR text = '')) OR (r = 'lang' AND (lang IS NULL OR lang NOT IN ('en', 'de'))) OR (r = 'short' AND (n_chars IS NULL OR n_chars > 4000))) AS broken FROM documents WHERE text IS NULL OR text = '' OR lang IS NULL OR lang NOT IN ('en', 'de') OR n_chars IS NULL OR n_chars > 4000")
def invalid_rows(read):
    rules = {"text": F.col("text") != "", "lang": F.col("lang").isin("en", "de"), "short": F.col("n_chars") <= 4000}
    return C.split_valid(read("documents"), rules)[1].select("doc_id", "broken")


@query("SELECT doc_id, coalesce(nullif(source, ''), 'Untitled') AS title, substr(coalesce(lang, ''), 1, 300) AS summary, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE coalesce(text, '') END AS text FROM documents")
def shaped_rows(read):
    d = read("documents")
    return C.shape(d, F.col("source"), F.col("lang"), F.col("text"), F.array("lang"), F.lit(None).cast("timestamp")).select("doc_id", "title", "summary", "text")


@query("SELECT p_partkey, list_filter(['small', 'steel', 'zzz'], lambda w: contains(lower(concat_ws(' ', p_name, p_type)), w)) AS terms FROM part")
def matched_terms(read):
    return read("part").select("p_partkey", C.matched_terms("Small steel zzz", F.col("p_name"), F.col("p_type")).alias("terms"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN regexp_replace(p_name, '(?i)(red)', '**\\1**', 'g') END AS title, CASE WHEN contains(lower(p_type), 'steel') THEN p_type END AS summary FROM part""")
def marked_rows(read):
    m = C.marked(F.col("p_name"), F.col("p_type"), ["red"])
    s = C.marked(F.col("p_name"), F.col("p_type"), ["steel"])
    return read("part").select("p_partkey", m["title"].alias("title"), s["summary"].alias("summary"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders ORDER BY place LIMIT 100")
def sorted_by_mode(read):
    from pyspark.sql.window import Window as W

    o = read("orders")
    few = o.orderBy(*C.sort_by("score-desc", {"score": "o_totalprice"}, "o_orderkey")).limit(100)
    return few.select("o_orderkey", F.row_number().over(W.orderBy(*C.sort_by("score-desc", {"score": "o_totalprice"}, "o_orderkey"))).alias("place"))


@query("SELECT DISTINCT substr(p_name, 1, 100) AS title FROM part WHERE contains(lower(p_name), 'ma') ORDER BY 1 LIMIT 10")
def suggest_titles(read):
    return C.suggest_titles(read("part"), "p_name", "Ma")


@query("WITH f AS (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200), d AS (SELECT event_id, ts::DATE AS day, lag(ts::DATE) OVER (ORDER BY ts DESC, event_id) AS before FROM f) SELECT event_id, day, before IS NULL OR before <> day AS header FROM d")
def day_headers(read):
    few = read("events").orderBy(F.desc("ts"), "event_id").limit(200)
    return C.with_day_headers(few, "ts", F.desc("ts"), F.col("event_id")).select("event_id", "day", "header")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) WHERE length(tag) >= 2 GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, tag LIMIT 50")
def tag_cloud_exploded(read):
    return C.tag_cloud(read("part").select(F.explode(F.split("p_type", " ")).alias("tag"))).select("tag", "n")


# Statistics and insights


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 10")
def top_domains(read):
    return insights.top_counts(read("documents"), "source")


@query("SELECT p_size AS value, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def score_histogram(read):
    return insights.histogram(read("part"), "p_size")


@query("SELECT count(*) AS total, count(*) FILTER (contains(text, 'tion')) AS with_code, count(*) FILTER (contains(text, '!!')) AS with_errors, round(avg(n_chars), 1) AS average_score, round(count(*) FILTER (contains(text, 'tion')) / count(*), 6) AS code_rate, round(count(*) FILTER (contains(text, '!!')) / count(*), 6) AS error_rate FROM documents")
def overview(read):
    out = insights.overview(read("documents"), F.contains("text", F.lit("tion")), F.contains("text", F.lit("!!")), F.col("n_chars"))
    return out.withColumns({c: F.round(c, 6) for c in ("code_rate", "error_rate")})


@query("SELECT arg_max(lang, n) AS value, round(max(n) / sum(n), 6) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def dominant_language(read):
    return insights.dominant(read("documents"), "lang").withColumn("share", F.round("share", 6))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS c FROM m),
  g AS (SELECT max(c) AS periods, coalesce(sum(n) FILTER (i < c // 2), 0) / greatest(max(c // 2), 1) AS early, coalesce(sum(n) FILTER (i >= c // 2), 0) / greatest(max(c - c // 2), 1) AS late FROM r)
  SELECT periods, round(early, 4) AS early, round(late, 4) AS late, round((late - early) / early * 100, 4) AS growth, CASE WHEN late > early THEN 'increasing' ELSE 'decreasing' END AS direction FROM g""")
def activity_trend(read):
    return insights.activity(read("orders"), "o_orderdate", least=-1.0).withColumns({c: F.round(c, 4) for c in ("early", "late", "growth")})


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT arg_max(day, n * 100000 - epoch(day) // 86400) AS day, max(n) AS n, round(avg(n), 4) AS mean FROM d")
def peak_day(read):
    return insights.peak_day(read("events"), "ts", times=0.0).withColumn("mean", F.round("mean", 4))


@query("SELECT period, n, sum(n) OVER (ORDER BY period)::BIGINT AS total FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n FROM orders GROUP BY 1)")
def running_activity(read):
    return insights.running(insights.monthly(read("orders"), "o_orderdate"), "period").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query()
def insight_list(read):
    o = read("orders")
    langs = F.array(F.split("o_orderpriority", "-")[1])
    return insights.insights(o, "o_orderdate", "o_orderstatus", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", (F.col("o_totalprice") / 10000), langs, F.col("o_orderstatus"))


@query("SELECT l_returnflag AS grp, kind, name, n, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, kind ORDER BY n DESC, name) AS r FROM (SELECT l_returnflag, 'status' AS kind, l_linestatus AS name, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, 'number', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY ALL)) WHERE r <= CASE kind WHEN 'status' THEN 1 ELSE 3 END")
def top_by_group(read):
    x = F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.col("l_linestatus").alias("name")), F.struct(F.lit("number").alias("kind"), F.col("l_linenumber").cast("string").alias("name"))))
    rows = read("lineitem").select(F.col("l_returnflag").alias("grp"), x.alias("x")).select("grp", "x.kind", "x.name")
    return insights.top_by_group(rows, "grp", "kind", "name", {"status": 1, "number": 3})


@query("""WITH t AS (SELECT label, 'd' || (vec_id % 7) AS name, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, name) AS r FROM t)
  SELECT label, max(CASE WHEN r = 1 THEN upper(name[1]) || name[2:] END) AS name FROM r GROUP BY 1""")
def cluster_labels(read):
    e = read("embeddings")
    things = e.select("vec_id", F.lit("tag").alias("kind"), F.concat(F.lit("d"), (F.col("vec_id") % 7).cast("string")).alias("name"))
    out = insights.cluster_labels(e.select(F.col("label").alias("cluster"), "vec_id"), things, "cluster", "vec_id")
    return out.select(F.col("cluster").alias("label"), F.col("label").alias("name"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def row_counts(read):
    return insights.row_counts({t: read(t) for t in ("documents", "pages", "embeddings")})


@query("SELECT count(*) AS total, count(*) FILTER (text IS NOT NULL AND text <> '') AS texts, count(*) FILTER (lang = 'en') AS english FROM documents")
def feature_counts(read):
    return insights.feature_counts(read("documents"), {"texts": F.coalesce(F.col("text") != "", F.lit(False)), "english": F.col("lang") == "en"})


# Runs, calls, failures, archives


def _runs(read) -> DataFrame:
    r = read("events").groupBy(F.col("user_id").alias("run_id"))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return r.agg(kind("view").alias("processed"), kind("error").alias("failed"), F.count("*").alias("calls"), kind("error").alias("failed_calls"), F.round(F.sum("value"), 6).alias("cost"), F.sum(F.length("props")).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.max("ts").alias("ended"))


_RUNS = "r AS (SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS processed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS calls, round(sum(value), 6) AS cost, sum(length(props)) AS it, max(ts) AS ended FROM events GROUP BY 1), m AS (SELECT *, CASE WHEN processed + failed > 0 THEN processed / (processed + failed) ELSE 0 END AS sr, failed / calls AS er, CASE WHEN processed > 0 THEN cost / processed ELSE 0 END AS cc FROM r)"


@query(f"WITH {_RUNS} SELECT run_id, round(sr, 6) AS success_rate, round(er, 6) AS error_rate, round(cc, 4) AS cost_per_conversation, (it + 1)::BIGINT AS total_tokens FROM m")
def run_metrics(read):
    out = runs.run_metrics(_runs(read))
    return out.select("run_id", F.round("success_rate", 6).alias("success_rate"), F.round("error_rate", 6).alias("error_rate"), F.round("cost_per_conversation", 4).alias("cost_per_conversation"), "total_tokens")


@query(f"WITH {_RUNS} SELECT CASE WHEN b >= 3 THEN 'critical' WHEN b >= 1 THEN 'degraded' ELSE 'healthy' END AS status, b AS bad FROM (SELECT count(*) FILTER (er > 0.2) AS b FROM (SELECT er FROM m ORDER BY ended DESC LIMIT 5))")
def run_health(read):
    return runs.health(runs.run_metrics(_runs(read)), "ended", limit=0.2)


@query(f"WITH {_RUNS} SELECT count(*) AS total_runs, sum(processed)::BIGINT AS total_conversations, sum(calls)::BIGINT AS total_calls, round(sum(cost), 2) AS total_cost, round(avg(sr), 6) AS mean_success_rate FROM m")
def run_dashboard(read):
    out = runs.dashboard(runs.run_metrics(_runs(read)), "ended")
    return out.select("total_runs", "total_conversations", "total_calls", F.round("total_cost", 2).alias("total_cost"), F.round("mean_success_rate", 6).alias("mean_success_rate"))


@query("SELECT o_orderpriority AS provider, count(*) AS calls, round(sum(o_totalprice), 2) AS cost, count(*) FILTER (o_orderstatus = 'F') AS failures, round(1 - count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success_rate, round(avg(o_totalprice), 4) AS latency FROM orders GROUP BY ROLLUP (o_orderpriority)")
def provider_stats(read):
    out = runs.provider_stats(read("orders"), "o_orderpriority", F.col("o_totalprice"), F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return out.withColumns({"cost": F.round("cost", 2), "success_rate": F.round("success_rate", 6), "latency": F.round("latency", 4)})


@query("SELECT count(*) AS calls, sum(length(props))::BIGINT AS tokens, round(sum(value), 2) AS cost, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events")
def api_usage(read):
    out = runs.usage(read("events"), F.length("props"), F.col("value"), F.col("event_type") != "error")
    return out.withColumns({"cost": F.round("cost", 2), "success_rate": F.round("success_rate", 6)})


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def last_runs(read):
    return runs.last(read("events"), 3, F.desc("ts"), F.desc("event_id"), by=["user_id"]).select("user_id", "event_id")


@query("SELECT count(*) AS found, count(*) FILTER (event_type IN ('view', 'error')) AS new, count(*) FILTER (event_type = 'click') AS duplicate, count(*) FILTER (event_type = 'view') AS processed, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'error')), 6) AS rate FROM events")
def processing_stats(read):
    named = F.when(F.col("event_type") == "view", "processed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "duplicate").otherwise("other")
    return runs.processing(read("events").withColumn("kind", named), "kind").withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, count(*) AS attempts, arg_max(event_id, epoch_us(ts)::HUGEINT * 10000000 + event_id) AS last_error, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1")
def failure_attempts(read):
    return runs.attempts(read("events").filter("event_type = 'error'"), ["user_id"], "ts", "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def failures_cleared(read):
    e = read("events")
    return runs.cleared(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase' and value > 95"), ["user_id"]).select("event_id")


@query("WITH b AS (SELECT event_type, (event_type <> 'error')::INT AS p, (event_type = 'error')::INT AS f FROM events) SELECT event_type, sum(p)::BIGINT AS processed, sum(f)::BIGINT AS failed FROM b GROUP BY ROLLUP (event_type)")
def state_stats(read):
    e = read("events")
    return runs.state_stats(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), "event_type")


@query("SELECT count(*) AS archives, sum(n)::BIGINT AS processed, sum(greatest(t - n, 0))::BIGINT AS pending, list(s ORDER BY s) FILTER (t > n) AS due FROM (SELECT o_orderstatus AS s, count(*) AS t, count(*) FILTER (o_totalprice < 400000 OR o_orderstatus = 'P') AS n FROM orders GROUP BY 1)")
def archive_status(read):
    done = F.count_if((F.col("o_totalprice") < 400000) | (F.col("o_orderstatus") == "P"))
    return runs.archive_status(read("orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("total"), done.alias("processed")))


@query("SELECT user_id, max(ts) AS cursor, count(*) AS n FROM events GROUP BY 1")
def cursor_state(read):
    e = read("events")
    part = lambda cond: runs.cursor(e.filter(cond), ["user_id"], "ts")
    return runs.advanced(part("event_id % 3 = 0"), part("event_id % 3 <> 0"), ["user_id"])


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(read):
    e = read("events").withColumn("now", F.lit(read("events").agg(F.max("ts")).first()[0]))
    return runs.kept_since(e, "ts", 10, F.col("now")).select("event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 40")
def recent_feedback(read):
    e = read("events").withColumn("now", F.lit(read("events").agg(F.max("ts")).first()[0]))
    return runs.recent(e, "ts", 5, F.col("now"), 40, F.col("event_type") == "click", "event_id").select("event_id")


@query("SELECT CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'missing' WHEN a = b AND x = y THEN 'unchanged' WHEN b > a THEN 'new_content' WHEN b < a THEN 'replaced' ELSE 'modified' END AS change, count(*) AS n FROM (SELECT doc_id, n_chars AS a, doc_id % 5 AS x FROM documents WHERE doc_id % 7 <> 0) FULL JOIN (SELECT doc_id, n_chars + doc_id % 3 - 1 AS b, doc_id % 4 AS y FROM documents WHERE doc_id % 11 <> 0) USING (doc_id) GROUP BY 1")
def archive_changes(read):
    d = read("documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "n_chars")
    old = d.filter("doc_id % 7 <> 0").select("path", F.col("n_chars").alias("bytes"), F.concat_ws("/", F.col("n_chars").cast("string"), (F.col("doc_id") % 5).cast("string")).alias("sha256"))
    size = F.col("n_chars") + F.col("doc_id") % 3 - 1
    now = d.filter("doc_id % 11 <> 0").select("path", size.alias("bytes"), F.concat_ws("/", size.cast("string"), (F.col("doc_id") % 4).cast("string")).alias("sha256"))
    return runs.changes(old, now).groupBy("change").agg(F.count("*").alias("n"))


# Entities, chains, projects


@query("SELECT kind, value, count(*) AS n FROM (SELECT 'tag' AS kind, unnest(list_distinct(string_split(lower(p_type), ' '))) AS value, p_partkey FROM part UNION ALL SELECT 'domain', lower(p_brand), p_partkey FROM part) GROUP BY ALL")
def entity_index(read):
    p = read("part").withColumn("tags", F.split("p_type", " "))
    return entities.inverted(p, "p_partkey", {"tag": "tags"}, "p_brand").groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size / 100.0 AS score FROM part WHERE list_contains(string_split(lower(p_type), ' '), 'steel') ORDER BY p_size DESC, p_partkey LIMIT 10")
def recommend_by_entity(read):
    p = read("part").withColumn("tags", F.split("p_type", " "))
    return entities.by_entity(entities.inverted(p, "p_partkey", {"tag": "tags"}), p, "p_partkey", "STEEL", score="p_size").withColumn("score", F.col("score").cast("double"))


@query("""WITH i AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_type), ' ')) AS v FROM part), w AS (SELECT DISTINCT v FROM i WHERE p_partkey IN (1, 2)),
  m AS (SELECT p_partkey, count(*) AS matches FROM i JOIN w USING (v) WHERE p_partkey NOT IN (1, 2) GROUP BY 1) SELECT p_partkey, matches, round(matches / (SELECT max(matches) FROM m), 6) AS score FROM m ORDER BY matches DESC, p_partkey LIMIT 10""")
def recommend_from_history(read):
    p = read("part").withColumn("tags", F.split("p_type", " "))
    index = entities.inverted(p, "p_partkey", {"tag": "tags"})
    return entities.from_history(index, p.filter("p_partkey in (1, 2)"), "p_partkey").withColumn("score", F.round("score", 6))


def _texts(read) -> DataFrame:
    """documents with words that the patterns know, put in by a rule."""
    words = F.array(*[F.lit(w) for w in ("python docker", "the api of react", "ValueError: x in /home/ann/shop/app.py", "git and github.com/ann/shop", "plain", "continuing from my last python test")])
    return read("documents").filter("doc_id is not null").select("doc_id", F.concat_ws(" ", F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int")), F.substring("text", 1, 0)).alias("text"))


@query("SELECT kind, name, count(*) AS mentions FROM (SELECT doc_id, unnest(CASE doc_id % 6 WHEN 0 THEN ['technology:python', 'technology:docker'] WHEN 1 THEN ['technology:react', 'concept:api'] WHEN 2 THEN ['error:valueerror', 'file:/home/ann/shop/app.py'] WHEN 3 THEN ['technology:git', 'technology:github'] WHEN 5 THEN ['technology:python', 'concept:testing'] ELSE [] END) AS e FROM documents), LATERAL (SELECT string_split(e, ':')[1] AS kind, string_split(e, ':')[2] AS name) GROUP BY ALL")
def entity_nodes(read):
    found = entities.extract(_texts(read), "doc_id", "text")
    return entities.build(found, "doc_id")[0].select("kind", "name", "mentions")


@query()
def entity_report(read):
    return entities.report(*entities.build(entities.extract(_texts(read), "doc_id", "text"), "doc_id"))


@query()
def project_list(read):
    return chains.projects(_texts(read), "doc_id", "text")


@query()
def chain_list(read):
    e = read("events").filter("event_type = 'error'").select(F.col("event_id").alias("doc_id"), "ts", F.col("user_id").alias("e"))
    rows = e.select("doc_id", "ts", F.when(F.col("doc_id") % 9 == 0, "continuing from my last").otherwise("plain").alias("text"))
    return chains.detect(rows, e.select("doc_id", "e"), "doc_id", "ts", "text", "e")


@query("""WITH x AS (SELECT event_id AS id, ts, user_id AS e FROM events WHERE event_type = 'error') SELECT a.id AS a, b.id AS b, 0.9::DOUBLE AS confidence FROM x a JOIN x b USING (e)
  WHERE b.id % 9 = 0 AND (a.ts < b.ts OR (a.ts = b.ts AND a.id < b.id)) AND b.ts - a.ts <= INTERVAL 4 HOUR""")
def continuation_pairs(read):
    e = read("events").filter("event_type = 'error'").select(F.col("event_id").alias("doc_id"), "ts", F.col("user_id").alias("e"))
    rows = e.select("doc_id", "ts", F.when(F.col("doc_id") % 9 == 0, "Continuing from my last").otherwise("plain").alias("text"))
    return chains.continuations(rows, e.select("doc_id", "e"), "doc_id", "ts", "text", "e")


@query(f"""WITH x AS (SELECT vec_id, embedding, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id AS t FROM embeddings WHERE embedding IS NOT NULL),
  p AS (SELECT ai, bi, {_COS} AS s FROM (SELECT x.vec_id AS ai, y.vec_id AS bi, x.embedding AS a, y.embedding AS b FROM x JOIN x y ON x.vec_id <> y.vec_id AND abs(epoch(x.t) - epoch(y.t)) <= 72 * 3600))
  SELECT ai AS a, bi AS b, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY ai ORDER BY s DESC, bi) AS r FROM p WHERE s >= 0.2) WHERE r <= 5""")
def semantic_pairs(read):
    e = read("embeddings").withColumn("t", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 3600))
    return chains.semantic_pairs(e, "vec_id", "t", "embedding", least=0.2).withColumn("similarity", F.round("similarity", 6))


# Answers, artifacts, changes


_ANSWER = "'DOMAIN: ' || p_brand || chr(10) || 'TAGS: ' || replace(p_type, ' ', ', ') || ', x, ,' || chr(10) || 'TOPICS: a, b' || chr(10) || 'SCORE: about ' || p_size || '/10'"


def _answers(read) -> DataFrame:
    said = F.concat(F.lit("DOMAIN: "), "p_brand", F.lit("\nTAGS: "), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit(", x, ,\nTOPICS: a, b\nSCORE: about "), F.col("p_size").cast("string"), F.lit("/10"))
    return read("part").select("p_partkey", said.alias("answer"), "p_type", "p_name", "p_brand")


@query("SELECT p_partkey, p_brand AS primary_domain, string_split(p_type, ' ') AS tags, ['a', 'b'] AS key_topics, least(p_size, 10) AS score FROM part")
def answer_lines(read):
    a = F.col("answer")
    return _answers(read).select("p_partkey", *A.tags_answer(a)[:3], A.score_answer(a)[0])


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE '{\"a\": ' || p_size || '}' END AS j FROM part")
def answer_json(read):
    body = F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.lit("}"))
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("It is "), body, F.lit(" I think"))).otherwise("no {json")
    return read("part").select("p_partkey", A.json_in(said).alias("j"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'added' WHEN p_partkey % 3 = 1 THEN NULL ELSE 'modified' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'added_items' WHEN 1 THEN 'removed_items' WHEN 2 THEN 'modified' END AS tags FROM part")
def field_changes(read):
    k = F.col("p_partkey")
    old = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("!")))
    tags = F.array(F.lit("a"), F.lit("b"))
    new = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(k % 4 == 1, F.array(F.lit("a"))).when(k % 4 == 2, F.array(F.lit("a"), F.lit("z"))).otherwise(tags)
    return read("part").select("p_partkey", A.change(old, F.col("p_name")).alias("name"), A.change(tags, new, lists=True).alias("tags"))


@query("SELECT CASE WHEN l IN ('bash', 'sh') THEN 'shell_command' WHEN l = 'sql' THEN 'sql_query' WHEN l = 'json' THEN 'configuration' ELSE 'code_snippet' END AS type, count(*) AS n FROM (SELECT ['bash', 'sh', 'sql', 'json', 'python', ''][1 + p_partkey % 6] AS l FROM part WHERE length(p_name || ' of ' || p_type) >= 30) GROUP BY 1")
def artifact_types(read):
    lang = F.element_at(F.array(*[F.lit(x) for x in ("bash", "sh", "sql", "json", "python", "")]), (1 + F.col("p_partkey") % 6).cast("int"))
    block = F.concat(F.lit("```"), lang, F.lit("\n"), "p_name", F.lit(" of "), "p_type", F.lit("\n```\n"))
    found = read("part").select(F.explode(A.artifacts(F.concat(block, block, F.lit("```\nshort\n```")), 30)).alias("a"))
    return found.groupBy("a.type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KB', n_chars / 1024.0::DOUBLE) END AS size, CASE WHEN n_chars < 60 THEN printf('%.1fs', n_chars::DOUBLE) WHEN n_chars < 3600 THEN (n_chars // 60) || 'm ' || (n_chars % 60) || 's' ELSE (n_chars // 3600) || 'h ' || (n_chars % 3600 // 60) || 'm' END AS took FROM documents WHERE n_chars < 100000")
def labels_of_sizes(read):
    d = read("documents").filter("n_chars < 100000")
    return d.select("doc_id", A.size_label(F.col("n_chars")).alias("size"), A.duration_label(F.col("n_chars")).alias("took"))


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,7}\\b') THEN 'local' ELSE 'remote' END AS route FROM documents")
def privacy_route(read):
    return read("documents").select("doc_id", pii.route(F.col("text"), ["email"]).alias("route"))


# Stores


@query("SELECT c_custkey::VARCHAR AS external_id FROM customer")
def external_ids(read):
    c = read("customer").select(F.col("c_custkey").alias("convo_id"), F.lit(None).cast("string").alias("external_id"))
    return stores.with_external_ids(c).select("external_id")


@query("SELECT p_partkey, p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS p_size FROM part")
def overwritten_table(read):
    """A table that is read, changed and written in its own place."""
    from ..workspace import new_path

    p = read("part").select("p_partkey", "p_size")
    spark, path = p.sparkSession, new_path(p.sparkSession, "table")
    stores.append(p.filter("p_partkey % 2 = 0"), path, "parquet")
    stores.append(p.filter("p_partkey % 2 = 1"), path, "parquet")
    now = stores.read_rows(spark, path, p.schema, "parquet")
    stores.overwrite(now.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0)), path, "parquet")
    return stores.read_rows(spark, path, p.schema, "parquet")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def bulk_upsert(read):
    p = read("part").select("p_partkey", "p_size")
    new = p.filter("p_partkey % 5 = 0").select("p_partkey", F.explode(F.array(F.col("p_size") + 1, F.col("p_size") + 100)).alias("p_size"), F.lit(1).alias("unknown"))
    return stores.bulk_import(p, new, ["p_partkey"], [F.desc("p_size")])


@query("SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) IS NOT NULL AS there FROM embeddings WHERE vec_id = 42")
def stored_vector(read):
    from ..workspace import new_path

    e = read("embeddings")
    path = new_path(e.sparkSession, "vectors")
    stores.save_vectors(e, path, "vec_id", "embedding")
    return stores.load_vectors(e.sparkSession, path, 42).select("id", F.col("vector").isNotNull().alias("there"))


@query("SELECT printf('sample-%06d', i::INT) AS convo_id, ['OpenAI', 'Anthropic', 'Google'][1 + i % 3] AS source, 'title ' || i % 2 AS title FROM range(100) t(i)")
def sample_rows(read):
    spark = read("region").sparkSession
    return stores.sample(spark, 100, [("title 0", "a", "x"), ("title 1", "b", "y")]).select("convo_id", "source", "title")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 50")
def chosen_rows(read):
    c = read("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("").alias("convo_id"), F.col("c_custkey").cast("string").alias("external_id"))
    return stores.chosen(c, c.filter("c_custkey <= 50").select(F.col("external_id").alias("id"))).select("c_custkey", "c_name")


# Segments and scores


@query("SELECT conv_id, turn::INT AS turn, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')")
def turns_from_text(read):
    rows = read("conversations").filter("role in ('user', 'assistant') and trim(text) <> ''")
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.regexp_replace("text", "\n", " "))
    raw = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("raw"))
    return segments.turns_of(raw, "raw").select("conv_id", "turn", "role")


@query()
def described_segments(read):
    return segments.topics(segments.described(read("conversations")))


@query("SELECT term, count(*) AS rows FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS term FROM part) GROUP BY 1")
def term_frequency(read):
    return scoring.term_frequency(read("part").select("p_partkey", F.split("p_type", " ").alias("terms")), "p_partkey", "terms")


@query("SELECT p_partkey, CASE WHEN p_size >= 75 THEN 'strong in depth' WHEN p_size <= 40 THEN 'weak in depth' ELSE 'balanced' END AS verdict FROM part")
def score_verdict(read):
    return read("part").select("p_partkey", scoring.verdict({"depth": F.col("p_size"), "clarity": F.lit(50)}).alias("verdict"))


@query("WITH c AS (SELECT label, list(m ORDER BY p) AS b FROM (SELECT label, p, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1, 2) GROUP BY 1), " + f"k AS (SELECT label, count(*) AS n, avg({_COS}) AS c FROM (SELECT label, embedding AS a, b FROM embeddings JOIN c USING (label)) GROUP BY 1) SELECT count(*) AS clusters, round(avg(c), 6) AS mean, round(sum(c * n) / sum(n), 6) AS weighted, round(min(c), 6) AS low, round(max(c), 6) AS high FROM k")
def coherence_summary(read):
    out = embed.coherence_summary(V.coherence(read("embeddings"), "label", "embedding"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "weighted", "low", "high")})


@query()
def text_vectors(read):
    return embed.embed(read("documents").select("doc_id", "text"), "text").select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query()
def density_clusters(read):
    return embed.cluster(read("embeddings").filter("embedding is not null"), "vec_id", "embedding", "density", similarity=0.4)


@query()
def hierarchical_clusters(read):
    return embed.cluster(read("embeddings").filter("embedding is not null"), "vec_id", "embedding", "hierarchical", k=4)
