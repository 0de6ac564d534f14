"""The registry of queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import pii, scoring, stem, text as T
from ..operators import clusters, components, context, costs, evaluate, graph, search, segments, tables, trends, vectors
from ..streaming import ingest
from .registry import oracle_sql, queries, query as _query  # noqa: F401

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(terms: list[str], fields: dict[str, float], every: bool, k: int) -> str:
    size = " + ".join(f"len(coalesce({TOK.format(f)}, []))" for f in fields)
    tf = ", ".join("(" + " + ".join(f"{w} * len(list_filter(coalesce({TOK.format(f)}, []), lambda x: x = '{t}'))" for f, w in fields.items()) + f")::DOUBLE AS t{i}" for i, t in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / av))" for i in range(len(terms)))
    cond = (" AND " if every else " OR ").join(f"t{i} > 0" for i in range(len(terms)))
    return f"""WITH r AS (SELECT doc_id, {size} AS l, {tf} FROM documents),
      s AS (SELECT count(*) AS n, avg(l) AS av, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(terms)))} FROM r)
      SELECT doc_id, round({score}, 6) AS score FROM r, s WHERE {cond} ORDER BY {score} DESC, doc_id LIMIT {k}"""


def _bm25(read, terms: list[str], fields: dict[str, float], every: bool, k: int) -> DataFrame:
    found = search.bm25(read("documents"), "doc_id", fields, terms, every)
    return search.top(found, "score", "doc_id", k).withColumn("score", F.round("score", 6))


@_query(_bm25_sql(["the", "and", "that"], {"text": 1.0}, True, 20))
def bm25_topk(read):
    return _bm25(read, ["the", "and", "that"], {"text": 1.0}, True, 20)


@_query(_bm25_sql(["que", "der", "est"], {"text": 1.0}, False, 20))
def bm25_or_topk(read):
    return _bm25(read, ["que", "der", "est"], {"text": 1.0}, False, 20)


@_query(_bm25_sql(["the", "src3"], {"text": 1.0, "source": 5.0}, False, 20))
def bm25_weighted_fields(read):
    return _bm25(read, ["the", "src3"], {"text": 1.0, "source": 5.0}, False, 20)


_J = "(' ' || array_to_string(" + TOK.format("text") + ", ' ') || ' ')"


@_query(f"""SELECT doc_id FROM documents WHERE {_J} LIKE '% th%' AND {_J} LIKE '% of the %' AND {_J} LIKE '% and %' AND {_J} NOT LIKE '% was %'""")
def query_and_prefix_not(read):
    return read("documents").filter(search.matches(F.col("text"), search.parse('th "of the" +and -was'))).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND NOT contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 50")
def like_fallback(read):
    return read("documents").filter(search.like(F.col("text"), search.parse("tion -the"))).orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'src1 ') OR contains(lower(concat_ws(' ', text, lang, source)), 'license')")
def substring_search(read):
    d = F.lower(F.concat_ws(" ", "text", "lang", "source"))
    return read("documents").filter(F.contains(d, F.lit("src1 ")) | F.contains(d, F.lit("license"))).select("doc_id")


_OCC = "((length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1})::INT"


@_query(f"""SELECT * FROM (SELECT doc_id, ({_OCC.format('tion', 4)} * CASE WHEN contains(lower(source), 'tion') THEN 3 ELSE 1 END + 2 * {_OCC.format('and', 3)} + 5)::BIGINT AS score
  FROM documents WHERE contains(lower(text), 'and') AND contains(lower(text), 'of the') AND NOT contains(lower(text), 'which')) ORDER BY score DESC, doc_id LIMIT 20""")
def heuristic_rank(read):
    d = read("documents").select("doc_id", search.heuristic(F.col("text"), F.col("source"), search.parse('tion +and "of the" -which')).cast("long").alias("score"))
    return search.top(d.filter("score > 0"), "score", "doc_id", 20)


@_query("""WITH s AS (SELECT doc_id, 5.0 * 3.0 * ((length(lower(text)) - length(replace(lower(text), 'art', ''))) // 3) AS a,
  list_sum([2.0 * ((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)) for w in ['art','design','music','writing','painting','photography','creative','artistic']]) AS b,
  list_sum([contains(lower(text), w)::INT for w in ['art','design','music','writing','painting','photography','creative','artistic']]) AS h FROM documents)
  SELECT doc_id, round(((a + b) * CASE WHEN h > 2 THEN 1.2 ELSE 1.0 END)::DOUBLE, 6) AS score FROM s WHERE a + b > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def synonym_rank(read):
    d = read("documents").select("doc_id", F.round(search.synonym_score(F.col("text"), F.col("source"), "art"), 6).alias("score"))
    return search.top(d.filter("score > 0"), "score", "doc_id", 50)


@_query("SELECT CASE WHEN grouping(source) = 0 THEN 'source' ELSE 'lang' END AS facet, CASE WHEN grouping(source) = 0 THEN source ELSE lang END AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def facets_source_lang(read):
    return search.facets(read("documents").select("source", "lang"), ["source", "lang"])


@_query("SELECT p_name, max(p_partkey) AS newest FROM part WHERE starts_with(lower(p_name), 'sma') GROUP BY 1 ORDER BY newest DESC, p_name LIMIT 10")
def suggest_prefix(read):
    return search.suggest(read("part"), "p_name", "Sma", "p_partkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= '1995-01-01' AND o_orderdate < '1997-01-01' AND o_totalprice BETWEEN 1000 AND 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def filtered_page(read):
    o = read("orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1997-01-01") & F.col("o_totalprice").between(1000, 200000))
    return tables.page(o, 2, 25, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@_query(r"SELECT doc_id, sha256(regexp_replace(text, '(?i)(the|tion)', '<mark>\1</mark>', 'g')) AS digest FROM documents")
def highlights_all(read):
    return read("documents").select("doc_id", F.sha2(search.highlight(F.col("text"), ["the", "tion", "x"]), 256).alias("digest"))


@_query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings)
  SELECT doc_id, round(coalesce(0.5 / (60 + a.r), 0) + coalesce(0.5 / (60 + b.r), 0), 9) AS score FROM (SELECT * FROM a WHERE r <= 60) a FULL JOIN (SELECT * FROM b WHERE r <= 60) b USING (doc_id) ORDER BY coalesce(0.5 / (60 + a.r), 0) + coalesce(0.5 / (60 + b.r), 0) DESC, a.r NULLS LAST, b.r NULLS LAST LIMIT 20""")
def rrf_hybrid(read):
    a = read("documents").select("doc_id", F.col("n_chars").alias("score"))
    b = read("embeddings").select(F.col("vec_id").alias("doc_id"), F.get("embedding", F.lit(0)).alias("score"))
    return search.rrf(a, b, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


_COS = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])))"


@_query(f"SELECT vec_id, round({_COS}, 6) AS similarity FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 7) AS b FROM embeddings WHERE vec_id <> 7) ORDER BY similarity DESC, vec_id LIMIT 10")
def cosine_topk(read):
    e = read("embeddings")
    found = vectors.top_k(e, e.filter("vec_id = 7"), "vec_id", "embedding", 10, exclude=e.filter("vec_id = 7").select("vec_id"))
    return found.withColumn("similarity", F.round("similarity", 6))


_CENT = "SELECT label, list(m ORDER BY p) AS b FROM (SELECT label, p, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1, 2) GROUP BY 1"


@_query(f"SELECT vec_id, round({_COS}, 6) AS similarity FROM (SELECT vec_id, embedding AS a, (SELECT b FROM ({_CENT}) WHERE label = 3) AS b FROM embeddings) ORDER BY similarity DESC, vec_id LIMIT 10")
def centroid_topk(read):
    e = read("embeddings")
    c = vectors.centroids(e.filter("label = 3"), ["label"], "embedding").select(F.col("centroid").alias("embedding"))
    return vectors.top_k(e, c, "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@_query(f"SELECT label, count(*) AS n, round(avg({_COS}), 6) AS coherence, round(1 - avg(list_distance(a::DOUBLE[], b)) / (max(list_distance(a::DOUBLE[], b)) + 1e-6), 6) AS spread FROM (SELECT label, embedding AS a, b FROM embeddings JOIN ({_CENT}) USING (label)) GROUP BY label")
def cluster_coherence(read):
    return vectors.coherence(read("embeddings"), "label", "embedding").withColumns({c: F.round(c, 6) for c in ("coherence", "spread")})


@_query("""SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
  least(count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant')) AS turns, coalesce(sum(length(text)) FILTER (role = 'user') // nullif(count(*) FILTER (role = 'user'), 0), 0)::BIGINT AS avg_user_length FROM conversations GROUP BY 1""")
def message_counts(read):
    u, a = F.col("role") == "user", F.col("role") == "assistant"
    out = read("conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(u).alias("user_messages"), F.count_if(a).alias("assistant_messages"), F.sum(F.when(u, F.char_length("text"))).alias("_l"))
    return out.withColumn("turns", F.least("user_messages", "assistant_messages")).withColumn("avg_user_length", F.coalesce(F.floor(F.col("_l") / F.nullif("user_messages", F.lit(0))), F.lit(0)).cast("long")).drop("_l")


@_query("SELECT conv_id, sha256('Conversation ' || conv_id || chr(10) || chr(10) || string_agg(upper(role) || ': ' || text || chr(10), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def raw_text_render(read):
    rows = read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.sha2(T.raw_text(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.col("m")), 256).alias("digest"))


@_query("SELECT sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '') || '||') AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_content_hash(read):
    none = F.lit(None).cast("string")
    h = T.content_hash(F.col("source"), F.col("lang"), F.col("text"), none, none)
    return read("documents").groupBy(h.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


@_query(r"""SELECT doc_id, length(text) - length(replace(text, '?', '')) AS questions, regexp_matches(text, '(?i)https?://') AS has_link, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x IN ('the', 'que', 'der', 'rest', 'test')))) AS words FROM documents""")
def zero_token_features(read):
    t = F.col("text")
    return read("documents").select("doc_id", T.question_count(t).cast("long").alias("questions"), F.expr("text rlike '(?i)https?://'").alias("has_link"), F.array_sort(F.array_distinct(F.filter(search.tokens(t), lambda x: x.isin("the", "que", "der", "rest", "test")))).alias("words"))


@_query()
def zero_token_all(read):
    return T.features(read("documents"), "text", ["doc_id"])


@_query()
def score_dimensions(read):
    return scoring.score_all(read("documents").select("doc_id", "text")).drop("text")


@_query("SELECT doc_id, 100.0 * rank() OVER (ORDER BY n_chars) / count(*) OVER () AS percentile FROM documents")
def score_percentile(read):
    return scoring.percentiles(read("documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", F.col("percentile").cast("double").alias("percentile"))


@_query("SELECT least(floor(p_retailprice / 250), 9)::INT AS bucket, count(*) AS n, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def score_buckets(read):
    return read("part").groupBy(F.least(F.floor(F.col("p_retailprice") / 250), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


_GRADE = "CASE " + " ".join(f"WHEN s >= {b} THEN '{g}'" for b, g in [(95, "A+"), (90, "A"), (87, "A-"), (85, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (50, "C"), (45, "C-"), (35, "D")]) + " ELSE 'F' END"


@_query(f"SELECT {_GRADE} AS grade, count(*) AS n FROM (SELECT least(100, p_size * 2) AS s FROM part) GROUP BY 1")
def grades(read):
    return read("part").groupBy(scoring.grade(F.least(F.lit(100), F.col("p_size") * 2)).alias("grade")).agg(F.count("*").alias("n"))


_RE2 = {n: r.replace("'", "''") for n, r, _, _ in pii.P.PII if n in ("email", "phone", "ip_address", "mac_address", "iban")}


@_query("SELECT " + ", ".join(f"sum(len(regexp_extract_all(text, '{r}')))::BIGINT AS {n}" for n, r in _RE2.items()) + " FROM documents")
def pii_counts_by_type(read):
    found = read("documents").select(*pii.counts(F.col("text"), list(_RE2)))
    return found.agg(*[F.sum(n).alias(n) for n in _RE2])


@_query(f"SELECT doc_id, sha256(regexp_replace(text, '{_RE2['email']}', '[REDACTED-EMAIL]', 'g')) AS digest FROM documents")
def pii_redact_email(read):
    return read("documents").select("doc_id", F.sha2(pii.redact_one(F.col("text"), "email"), 256).alias("digest"))


@_query()
def pii_audit(read):
    return pii.audit(pii.scrub(read("documents").select("doc_id", "text"), mode="hash"))


@_query(r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g'))) AS digest FROM pages""")
def html_to_text(read):
    return read("pages").select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("digest"))


@_query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def title_extract(read):
    return read("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@_query(r"SELECT regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def link_domains(read):
    return read("pages").groupBy(T.host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@_query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS title, CASE WHEN length(text) <= 400 THEN length(text) ELSE 405 END AS cut FROM documents")
def titles(read):
    return read("documents").select("doc_id", T.title(F.col("text")).alias("title"), F.char_length(T.middle_cut(F.col("text"), 400)).alias("cut"))


@_query("SELECT l_partkey, count(*) AS mentions, count(DISTINCT l_orderkey) AS groups FROM lineitem GROUP BY 1 ORDER BY mentions DESC, l_partkey LIMIT 50")
def graph_top_nodes(read):
    return graph.nodes(read("lineitem"), "l_orderkey", "l_partkey").orderBy(F.desc("mentions"), "l_partkey").limit(50)


@_query("""WITH x AS (SELECT event_id, user_id, ts FROM events) SELECT b.event_id, count(a.event_id) AS earlier FROM x b JOIN x a ON a.user_id = b.user_id AND a.ts < b.ts AND a.ts >= b.ts - INTERVAL 4 HOUR GROUP BY 1""")
def lookback_asof(read):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-4 * 3_600_000_000, -1)
    return read("events").select("event_id", "user_id", us.alias("t")).withColumn("earlier", F.count("*").over(w)).filter("earlier > 0").select("event_id", "earlier")


@_query("SELECT user_id, count(DISTINCT event_id) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(DISTINCT event_id) >= 2 AND epoch_us(max(ts)) - epoch_us(min(ts)) <= 700 * 3600000000::BIGINT")
def debug_sessions(read):
    return context.shared_groups(read("events").filter("event_type = 'error'"), "event_id", "ts", "user_id", 700).withColumn("hours", F.round("hours", 6))


_ALL_PAIRS = "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS groups, count(*) + 1.0 AS weight FROM x a JOIN x b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY 1, 2)"


@_query(f"{_ALL_PAIRS} SELECT a, b, groups, weight::DOUBLE AS weight FROM e")
def cooccurrence_edges_all(read):
    return graph.edges(read("lineitem"), "l_orderkey", "l_partkey")


@_query(f"{_ALL_PAIRS} SELECT CASE WHEN a = 11 THEN b ELSE a END AS entity, weight::DOUBLE AS weight FROM e WHERE a = 11 OR b = 11 ORDER BY weight DESC, entity LIMIT 10")
def graph_related_all(read):
    return graph.related(graph.edges(read("lineitem"), "l_orderkey", "l_partkey"), 11)


@_query()
def graph_components_all(read):
    return components.connected_components(read("orders").select(F.col("o_custkey").alias("src"), (-F.floor(F.col("o_orderkey") / 40) - 1).alias("dst")))


@_query("""WITH x AS (SELECT event_id AS id, epoch_us(ts) AS t, event_type || '|' || user_id AS e FROM events)
  SELECT a.id AS a, b.id AS b, count(DISTINCT a.e) AS shared, round(min((b.t - a.t) / 3.6e9), 6) AS hours_apart FROM x a JOIN x b ON a.e = b.e AND (a.t < b.t OR (a.t = b.t AND a.id < b.id)) AND b.t - a.t <= 86400000000 GROUP BY 1, 2""")
def similar_pairs_window_all(read):
    ev = read("events").filter("event_type is not null and user_id is not null").withColumn("e", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    return context.band_pairs(ev, "event_id", "ts", "e", 24, 1).withColumn("hours_apart", F.round("hours_apart", 6))


@_query("""WITH b AS (SELECT DISTINCT s_nationkey AS r, l_partkey AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT r, count(*) AS n FROM b GROUP BY 1)
  SELECT x.r AS a, y.r AS b, count(*) AS shared FROM b x JOIN b y USING (m) JOIN n p ON p.r = x.r JOIN n q ON q.r = y.r WHERE x.r < y.r GROUP BY 1, 2, p.n, q.n HAVING count(*) >= 0.5 * least(p.n, q.n)""")
def project_overlap_all(read):
    return context.overlapping_roots(read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_partkey"), "s_nationkey", "l_partkey")


_GROW = """, y AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS c FROM s),
  g AS (SELECT {k}, max(c) AS periods, coalesce(sum(n) FILTER (i < c // 2), 0) / greatest(max(c // 2), 1) AS early, coalesce(sum(n) FILTER (i >= c // 2), 0) / greatest(max(c - c // 2), 1) AS late FROM y GROUP BY {k}),
  h AS (SELECT *, CASE WHEN periods < 2 THEN 0 WHEN early > 0 THEN (late - early) / early * 100 WHEN late > 0 THEN 100 ELSE 0 END AS growth FROM g)
  SELECT {k}, periods, round(early, 6) AS early, round(late, 6) AS late, round(growth, 6) AS growth, CASE WHEN growth > 10 THEN 'rising' WHEN growth < -10 THEN 'declining' ELSE 'stable' END AS direction FROM h"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("early", "late", "growth")})


@_query("WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders), k AS (SELECT DISTINCT o_orderpriority FROM orders), s AS (SELECT o_orderpriority, period, coalesce(n, 0) AS n FROM p CROSS JOIN k LEFT JOIN (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1, 2) USING (o_orderpriority, period))" + _GROW.format(k="o_orderpriority"))
def monthly_trend_growth(read):
    o = read("orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    return _rounded(trends.growth(trends.zero_filled(o, "period", "o_orderpriority"), ["o_orderpriority"]))


@_query("WITH s AS (SELECT event_type, format('{:d}-W{:02d}', isoyear(ts), week(ts)) AS period, count(*) AS n FROM events GROUP BY 1, 2)" + _GROW.format(k="event_type"))
def weekly_trend(read):
    e = read("events").groupBy("event_type", T.week_label(F.col("ts").cast("timestamp")).alias("period")).agg(F.count("*").alias("n"))
    return _rounded(trends.growth(e, ["event_type"]))


@_query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, round(avg(o_totalprice), 4) AS quality FROM orders GROUP BY 1")
def quality_over_time(read):
    return read("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("quality"))


@_query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d, count(*) AS c FROM orders) SELECT round(max(m), 4) AS mean, round(max(d), 4) AS std, max(c) AS total, count(*) FILTER (o_totalprice < m - 1.2 * d) AS low FROM orders, s")
def anomaly_sigma(read):
    return trends.sigma_outliers(read("orders"), "o_totalprice", 1.2).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@_query("WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n FROM d WHERE n > 1.05 * (SELECT avg(n) FROM d)")
def activity_spike(read):
    d = read("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.join(F.broadcast(d.agg(F.avg("n").alias("_m")))).filter(F.col("n") > 1.05 * F.col("_m")).select("day", "n")


@_query("SELECT user_id % 50 AS g, count(*) FILTER (event_type IN ('view', 'show')) AS views, count(*) FILTER (event_type = 'click') AS clicks, round(CASE WHEN count(*) FILTER (event_type IN ('view', 'show')) > 0 THEN count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('view', 'show')) ELSE 0 END, 6) AS ctr FROM events GROUP BY 1")
def ctr(read):
    return evaluate.click_through(read("events").withColumn("g", F.col("user_id") % 50), ["g"], F.col("event_type")).withColumn("ctr", F.round("ctr", 6))


_HEALTH = "CASE WHEN s IS NULL THEN 'unknown' WHEN s >= 0.7 THEN 'healthy' WHEN s >= 0.56 THEN 'degraded' ELSE 'critical' END"


@_query(f"SELECT source, total, positive, negative, neutral, round(mean, 6) AS mean, round(s, 6) AS satisfaction, {_HEALTH} AS status FROM (SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative, 0::BIGINT AS neutral, avg(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS mean, count(*) FILTER (quality = 1) / count(*) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def feedback_stats(read):
    rows = read("labels").join(read("documents").select("doc_id", "source"), "doc_id")
    return evaluate.feedback(rows, ["source"], F.when(F.col("quality") == 1, 1).otherwise(-1)).withColumns({c: F.round(c, 6) for c in ("mean", "satisfaction")})


@_query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, event_type = 'click' AS c FROM events WHERE event_type IN ('view', 'click')), a AS (SELECT user_id, count(*) AS n, sum(c::INT)::BIGINT AS clicks, coalesce(max(1.0::DOUBLE / p) FILTER (c), 0) AS mrr, sum(c::INT / log2(p + 1)) AS dcg FROM l GROUP BY 1)
  SELECT user_id, n, clicks, round(clicks / n, 6) AS precision, round(mrr, 6) AS mrr, round(CASE WHEN clicks > 0 THEN dcg / (list_sum([1 / log2(k + 1) for k in range(1, clicks + 1)])) ELSE 0 END, 6) AS ndcg FROM a""")
def ndcg_session(read):
    rows = read("events").filter("event_type in ('view', 'click')").withColumn("p", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).withColumn("c", F.col("event_type") == "click")
    return evaluate.ranked(rows, "user_id", "p", "c").withColumns({c: F.round(c, 6) for c in ("precision", "mrr", "ndcg")})


_TAGA, _TAGB = "['b' || (p_size % 5), 'c' || (p_size % 3), 'x']", "['b' || (p_size % 4), 'c' || (p_size % 3)]"


@_query(f"SELECT p_partkey, round(k / len(list_distinct({_TAGA})), 6) AS precision, round(k / len(list_distinct({_TAGB})), 6) AS recall, round(CASE WHEN k > 0 THEN 2 * (k / 3) * (k / 2) / (k / 3 + k / 2) ELSE 0 END, 6) AS f1 FROM (SELECT p_partkey, p_size, len(list_intersect({_TAGA}, {_TAGB})) AS k FROM part)")
def tag_f1(read):
    a = F.array(F.concat(F.lit("b"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")), F.lit("x"))
    b = F.array(F.concat(F.lit("b"), (F.col("p_size") % 4).cast("string")), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")))
    out = read("part").select("p_partkey", *evaluate.tag_scores(a, b))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@_query("WITH v AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1) SELECT event_type, round(list_avg(v), 4) AS mean, v[least(floor(len(v) * 0.5) + 1, len(v))::INT] AS p50, v[least(floor(len(v) * 0.95) + 1, len(v))::INT] AS p95, v[least(floor(len(v) * 0.99) + 1, len(v))::INT] AS p99, v[len(v)] AS high FROM v")
def latency_percentiles(read):
    out = trends.indexed_percentiles(read("events"), ["event_type"], "value", {"p50": (0.5, 0), "p95": (0.95, 20), "p99": (0.99, 100)})
    return out.select("event_type", F.round("mean", 4).alias("mean"), "p50", "p95", "p99", F.col("largest").alias("high"))


@_query("SELECT o_orderpriority AS provider, o_orderstatus AS model, count(*) AS calls, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def provider_rollup(read):
    return read("orders").rollup(F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


@_query("WITH s AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS m, avg(o_totalprice) / 1e5 AS v FROM orders GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS i FROM s) SELECT o_orderpriority, count(*) AS n, round(regr_slope(v, i), 6) AS slope, CASE WHEN count(*) < 3 THEN 'stable' WHEN regr_slope(v, i) > 0.01 THEN 'improving' WHEN regr_slope(v, i) < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM x GROUP BY 1")
def slope_trend(read):
    s = read("orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg((F.avg("o_totalprice") / 1e5).alias("v"))
    return trends.slope(s, "m", "v", ["o_orderpriority"]).withColumn("slope", F.round("slope", 6))


@_query("SELECT event_type AS kind, 'high' AS alert, count(*) AS n FROM events WHERE value > 90 GROUP BY 1")
def threshold_alerts(read):
    return read("events").filter("value > 90").groupBy(F.col("event_type").alias("kind")).agg(F.lit("high").alias("alert"), F.count("*").alias("n"))


@_query()
def topic_segments(read):
    return segments.segments(read("conversations"))


@_query("SELECT conv_id, turn FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r > 1 AND regexp_matches(text, '(?i)(?:by the|of the|and the|avec|von der)')")
def topic_boundaries(read):
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = read("conversations").withColumn("r", F.row_number().over(w))
    return rows.filter((F.col("r") > 1) & F.col("text").rlike("(?i)(?:by the|of the|and the|avec|von der)")).select("conv_id", "turn")


@_query("SELECT p_partkey, p_size FROM part WHERE greatest(coalesce(p_size, 0), p_retailprice / 100) >= 15 ORDER BY p_size DESC, p_partkey")
def focus_list(read):
    return read("part").filter(F.greatest(F.coalesce("p_size", F.lit(0)), F.col("p_retailprice") / 100) >= 15).select("p_partkey", "p_size")


@_query("SELECT p_partkey, coalesce(nullif(p_name, ''), 'Untitled') AS title FROM part")
def index_meta(read):
    return tables.paged_names(read("part"), "p_partkey", F.col("p_name"))


@_query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(read):
    return tables.latest(read("events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def anti_join_new(read):
    known = read("orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return tables.unseen(read("customer").select("c_custkey"), known, ["c_custkey"])


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_export(read):
    return read("customer").join(read("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@_query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, count(*) FILTER (n_chars < 500) AS short FROM documents GROUP BY 1")
def source_profile(read):
    rows = read("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"))
    return rows.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@_query("SELECT l_returnflag AS tag, count(*) AS n, ceil(count(*) / max(count(*)) OVER () * 5)::INT AS size FROM lineitem GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, tag LIMIT 50")
def tag_cloud(read):
    t = read("lineitem").groupBy(F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n")).filter("n >= 5")
    return t.withColumn("size", F.ceil(F.col("n") / F.max("n").over(W.partitionBy()) * 5).cast("int")).orderBy(F.desc("n"), "tag").limit(50)


@_query("SELECT count(*) AS total, count(DISTINCT source) AS sources, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 2) AS mean FROM documents")
def repository_stats(read):
    return read("documents").agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 2).alias("mean"))


@_query("WITH s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 5), c AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS shared FROM lineitem JOIN s USING (l_partkey) WHERE l_suppkey <> 5 GROUP BY 1 ORDER BY shared DESC, l_suppkey LIMIT 5) SELECT l_suppkey, shared, round(shared / max(shared) OVER (), 6) AS score FROM c")
def shared_entity_recommendations(read):
    return evaluate.shared_entities(read("lineitem"), "l_suppkey", "l_partkey", 5).withColumn("score", F.round("score", 6))


@_query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY ORDER BY value DESC, ts DESC, event_id LIMIT 20")
def trending(read):
    e = read("events")
    newest = e.agg(F.max("ts").alias("_m"))
    return e.join(F.broadcast(newest)).filter(F.col("ts") >= F.col("_m") - F.expr("INTERVAL 3 DAY")).orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(20).select("event_id")


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_1d(read):
    return ingest.windowed(read("events"), "ts", "1 day", ["event_type"])


@_query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM y GROUP BY user_id, k")
def session_windows(read):
    return ingest.sessions(read("events"), "ts", "6 hours", ["user_id"])


@_query("SELECT event_id, event_type FROM events")
def stream_ingest_dedup(read):
    e = read("events")
    folder = ingest.new_path(e.sparkSession, "landing")
    e.union(e).write.parquet(folder)
    return ingest.ingested(e.sparkSession, folder, ["event_id"], "ts").select("event_id", "event_type")


@_query("SELECT event_id, round((coalesce(user_id, 0) * CASE WHEN starts_with(event_type, 'purch') THEN 3.0 ELSE 0.5 END + coalesce(length(props), 0) * CASE WHEN starts_with(event_type, 'purch') THEN 15.0 ELSE 1.5 END)::DOUBLE / 1e6, 9) AS cost_usd FROM events")
def token_costs(read):
    calls = read("events").select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.char_length("props").alias("output_tokens"))
    return costs.token_costs(calls, {"purch": (3.0, 15.0)}, (0.5, 1.5)).select("event_id", F.round("cost_usd", 9).alias("cost_usd"))


@_query("SELECT count(*) AS n, count(*)::DOUBLE * 0.025 AS cost_usd FROM documents")
def cost_estimate(read):
    return costs.estimate(read("documents").select("doc_id"), 0.025)


@_query()
def stemmed_vocabulary(read):
    return stem.stems(read("documents").select(F.explode(search.tokens(F.col("text"))).alias("term")))


@_query()
def kmeans_clusters(read):
    return clusters.kmeans(read("embeddings"), "vec_id", "embedding")
