"""The pipeline, stage by stage, against what its operators say of the rows."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lumenarc.llm import decontaminate, langid, quality, simhash
from lumenarc.workspace import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    keep = {
        "quality": lambda d: quality.classify(d, labels).filter("keep"),
        "language": lambda d: langid.identify(d).filter("lang_pred <> 'und' and score >= 0.5"),
        "near_duplicates": lambda d: simhash.near_copies(d).filter("doc_id = component_id"),
        "decontamination": lambda d: decontaminate.contamination(d, items).filter("not contaminated"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(r.doc_id for r in keep[name](docs).collect())
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(r.doc_id for r in docs.collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == docs.count() == len(want) > 100


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_odd_rows_and_names(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, and columns that are called as the stages' own."""
    words = ["the", "and", "house", "tree", "river", "stone", "bird", "cloud", "green", "small"]
    rng = random.Random(6)
    clean = [(k, " ".join(rng.choice(words) for _ in range(60 + k)), "en", f"s{k % 3}", k) for k in range(60)]
    odd = [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, clean[3][1] + " stone bird", "en", None, 1), (7, clean[7][1], "en", "s1", 7), (102, clean[8][1], None, "s2", 1), (103, "zqx#" * 3000, "en", "s0", 1), (104, " ".join(words * 3000), "en", "s1", 1)]
    names = ["_h", "h", "fp", "rep", "batch", "lang_model", "key", "size", "start", "keep", "_key"]
    docs = spark.createDataFrame(clean + odd, DOC).withColumns({c: F.lit(c) for c in names})
    item = " ".join(clean[5][1].split()[:20])
    write(spark, tmp_path, docs, [(k, 1, 0) for k in range(50)] + [(None, 1, 0), (50, None, None)], [(1, item), (None, None), (2, "")])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns and all(r[c] == c for r in now.collect() for c in names)
    left = [r.doc_id for r in now.collect()]
    assert set(left) <= {*range(60), None, 102, 104} and 5 not in left and left.count(7) <= 1 and 102 not in left and len(left) > 40
    assert {r.lang for r in now.collect()} == {"en"}


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, spark.createDataFrame([], DOC), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
