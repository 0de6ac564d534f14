"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, hilbert, langid, licenses, mixing, quality, simhash, warc, webtext


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(_read(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: the source and the language are directories, the id is the file's name.

    No name says that a file is a license file, so a document whose whole text is a notice is one.
    Documents without a source have no path, since nothing says that they belong together.
    """
    docs = _read(spark, sf_dir, "documents")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt"))
    path = F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"), name)
    return licenses.scan(docs.withColumn("path", path), keep=["doc_id"], by_content=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digests(chat.format_chats(rows.unionByName(probe)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(_read(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_hilbert_ann, op2_licenses, op3_quality, op4_language_id, op5_chat_format, op6_decontaminate, op7_html_text, op8_warc, op9_simhash, op10_mix, pipeline)
    return {f.__name__: f for f in own}


_SAID = "'</s>[INST] ok [/INST]'"
_WORD6 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Escapes of the template, as SQL: what formatted_chars counts.
_ESCAPED = r"regexp_replace(replace(t, '\', '\\'), '(<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[TURN\]|\[/TURN\])', '\1x', 'g')"

OP5_SQL = rf"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t) AS said,
    coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '') AS learned,
    string_agg(CASE r WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, r, t) AS path,
    sum(length({_ESCAPED}) + CASE r WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(r) END) AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  CASE WHEN regexp_full_match(path, 's?u(au)*a') THEN 'answered' WHEN regexp_full_match(path, 's?u(au)*') THEN 'asked' WHEN path = 's' THEN 'told' ELSE 'invalid' END AS state,
  regexp_full_match(path, 's?u(au)*a') AS valid
FROM c
"""

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD6}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD6}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
), met AS (SELECT doc_id, item_id, k, i FROM grams JOIN win USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items x USING (doc_id)
"""

#: Five hexadecimal digits of a SHA-1 are four digits of base 32.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
d AS (SELECT *, sha1(payload) AS hex, page_id IS DISTINCT FROM first_id AS again FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) % 32, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM d
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute force, exact round trips or held-out rows."""
    return {"op5_chat_format": OP5_SQL, "op6_decontaminate": OP6_SQL, "op8_warc": OP8_SQL}
