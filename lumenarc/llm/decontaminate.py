"""Benchmark decontamination with a distributed positional inverted index. All native.

The index stores postings (document, term, position), sharded by document, so building it needs no shuffle. A query
starts from the rarest terms of each window of a test item: their lists, shifted by the terms' offsets in the item,
name the alignments (document, item, start) that may match. Only for those documents are the other lists read and
intersected, which gives the exact phrase matches; proximity matches take the same route without fixed offsets.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..workspace import materialize, small_enough, unused

#: Fixed value: a word, once A-Z have become lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of each document in the index; no word can equal it. Its position is the word count.
END = "\x00"
#: Rows up to which a side of a join is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
RARE = 3
#: Positions, as a power of two, in one stretch of a document.
STRETCH = 7


class Index(NamedTuple):
    """postings: doc_id, key, tid, pos. terms: term, tid (tid 0 is END). key tells documents with one id apart."""

    postings: DataFrame
    terms: DataFrame


def words(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased and no other letter."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.coalesce(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The postings of the given terms (column term) in all of docs, written to the shared folder."""
    named = terms.select("term").filter(F.col("term") != END).dropna().distinct()
    named = materialize(named.select("term", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("k")), "vocabulary")
    # numbers without gaps: a partition's first one is the sum of the partitions before it, one row each
    first = named.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n") + 1).alias("first"))
    named = named.join(F.broadcast(first), "part").select("term", (F.col("first") + F.col("k")).cast("int").alias("tid"))
    named = materialize(named.union(docs.sparkSession.createDataFrame([(END, 0)], "term string, tid int")), "terms")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.posexplode(F.concat(words(F.col(text_col)), F.array(F.lit(END)))).alias("pos", "term"))
    postings = rows.join(_side(named), "term").select("doc_id", "key", "tid", "pos")
    return Index(materialize(postings, "postings"), named)


def _classes(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(cls, toks, n, w, item_ids): one row for each word sequence among the items; items without words are left out."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("toks")).filter(F.size("toks") > 0)
    rows = rows.groupBy("toks").agg(F.collect_set("item").alias("item_ids"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("cls"), "toks", F.size("toks").alias("n"), F.least(F.size("toks"), F.lit(window)).alias("w"), "item_ids"), "classes")


def _item_postings(classes: DataFrame, index: Index) -> DataFrame:
    """(cls, n, w, ipos, tid, df): every word of every item, and how often the corpus has it."""
    df = index.postings.groupBy("tid").agg(F.count("*").alias("df"))
    rows = classes.select("cls", "n", "w", F.posexplode("toks").alias("ipos", "term")).join(index.terms, "term")
    return materialize(rows.join(df, "tid", "left").select("cls", "n", "w", "ipos", "tid", F.coalesce("df", F.lit(0)).alias("df")), "item_postings")


def phrase_matches(index: Index, classes: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, key, cls, start, lo, hi): the positions from lo to before hi that an alignment of an item's windows hits."""
    own = _item_postings(classes, index)
    ahead = W.partitionBy("cls").orderBy("ipos").rowsBetween(0, window - 1)
    rare = own.select("cls", "w", "n", "ipos", F.slice(F.array_sort(F.collect_list(F.struct("df", "ipos", "tid")).over(ahead)), 1, RARE).alias("few"))
    rare = rare.filter((F.col("ipos") <= F.col("n") - F.col("w")) & (F.element_at("few", 1)["df"] > 0))  # a term that no document has rules its windows out
    anchors = materialize(rare.select("cls", "w", F.explode("few").alias("a")).select("cls", "w", "a.tid", "a.ipos").distinct(), "anchors")
    met = index.postings.join(_side(anchors), "tid").select("doc_id", "key", "cls", "w", (F.col("pos") - F.col("ipos")).alias("start"), "ipos")
    lined = met.groupBy("doc_id", "key", "cls", "w", "start").agg(F.count_distinct("ipos").alias("n")).filter(F.col("n") >= F.least("w", F.lit(RARE)))
    lined = materialize(lined.select("doc_id", "key", "cls", "w", "start"), "alignments")
    # the other lists, of those documents only
    wanted = lined.select("doc_id", "key").distinct()
    wanted = _side(wanted.select(F.col("doc_id").alias("d"), F.col("key").alias("k")))
    at = lambda pos, tid: F.shiftleft(pos.cast("long"), 31) + tid
    lists = index.postings.filter("tid > 0").join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    # lists and alignments meet in stretches of positions, so a long or monotonous text is no long list
    lists = lists.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.shiftright("pos", STRETCH).alias("s")).agg(F.collect_set(at(F.col("pos"), F.col("tid"))).alias("there"))
    tids = own.groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("ipos", "tid"))), lambda x: x["tid"]).alias("tids"))
    due = lined.join(tids, "cls").withColumn("stretch", F.explode(F.sequence(F.shiftright(F.greatest("start", F.lit(0)), STRETCH), F.shiftright(F.col("start") + F.size("tids") - 1, STRETCH))))
    full = due.join(lists, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("stretch") == F.col("s")))
    line = F.filter(F.transform("tids", lambda t, i: at(F.col("start") + i, t)), lambda x: x >= 0)
    full = full.select("doc_id", "key", "cls", "w", "start", F.array_intersect(line, F.col("there")).alias("p")).groupBy("doc_id", "key", "cls", "w", "start").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    full = full.withColumn("p", F.transform("p", lambda x: F.shiftright(x, 31).cast("int")))
    last = F.size("p") - F.col("w")
    runs = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda k: F.get("p", k + F.col("w") - 1) - F.get("p", k) == F.col("w") - 1))
    full = full.select("doc_id", "key", "cls", "start", F.transform(runs, lambda k: F.struct(F.get("p", k).alias("lo"), (F.get("p", k) + F.col("w")).alias("hi"))).alias("r"))
    # windows that meet or overlap are one interval
    join_up = F.aggregate(
        "r", F.array().cast("array<struct<lo:int,hi:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= x["lo"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), x["hi"].alias("hi"))))).otherwise(F.concat(done, F.array(x))),
    )
    return full.filter(F.size("r") > 0).select("doc_id", "key", "cls", "start", F.explode(join_up).alias("x")).select("doc_id", "key", "cls", "start", "x.lo", "x.hi")


def proximity_matches(index: Index, classes: DataFrame, slop: int = 4) -> DataFrame:
    """(doc_id, key, cls, start, end): the spans of at most n + slop words that hold all words of an item, in any order.

    n is the item's number of words. Each start that begins such a span is given with its first end. Documents come
    from the list of the item's rarest term; only their lists of the item's terms are read.
    """
    own = _item_postings(classes, index)
    first = own.groupBy("cls").agg(F.min(F.struct("df", "tid")).alias("r")).filter("r.df > 0").select("cls", "r.tid")
    docs = index.postings.join(_side(first), "tid").select("doc_id", "key", "cls").distinct()
    terms = own.select("cls", "n", "tid").distinct().withColumn("need", F.count("*").over(W.partitionBy("cls")))
    docs = docs.join(terms, "cls").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "cls", "n", "need", F.col("tid").alias("t"))
    met = index.postings.join(docs, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")))
    met = met.groupBy("doc_id", "key", "cls", "n", "need").agg(F.sort_array(F.collect_set(F.struct("pos", "tid"))).alias("p"))
    first_end = lambda x: F.filter("p", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + F.col("n") + slop))
    spans = met.select("doc_id", "key", "cls", "need", F.explode(F.transform("p", lambda x: F.struct(x["pos"].alias("start"), first_end(x).alias("near")))).alias("s"))
    spans = spans.select("doc_id", "key", "cls", "need", "s.start", "s.near")
    enough = F.filter(F.sequence(F.lit(1), F.size("near")), lambda k: F.size(F.array_distinct(F.transform(F.slice("near", F.lit(1), k), lambda y: y["tid"]))) == F.col("need"))
    return spans.withColumn("k", F.get(enough, F.lit(0))).filter("k is not null").select("doc_id", "key", "cls", "start", F.element_at("near", F.col("k"))["pos"].alias("end"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    A window is `window` consecutive words of an item, or all words of a shorter one. A word of a document is hit if it
    lies in an occurrence of a window. A document is contaminated if a twentieth or more of its words are hit. Null and
    empty texts have no words and are never contaminated; items without words have no window. Items that repeat a text
    count each; an item without an id hits but is not listed. Rows that repeat come back as often. Empty tables on
    either side are fine. Other columns are not read.
    """
    classes = _classes(items, item_col, item_text, window)
    index = build_index(docs, classes.select(F.explode("toks").alias("term")), id_col, text_col)
    spans = materialize(phrase_matches(index, classes, window).select("doc_id", "key", "cls", "lo", "hi"), "spans")
    ids = spans.select("doc_id", "key", "cls").distinct().join(classes.select("cls", "item_ids"), "cls")
    ids = ids.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"))
    # the length of the union: of each span, in order, what reaches beyond all before it
    before = F.max("hi").over(W.partitionBy("doc_id", "key").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.col("hi") - F.greatest("lo", F.coalesce(before, F.lit(0))), F.lit(0))
    hits = spans.groupBy("doc_id", "key", "lo").agg(F.max("hi").alias("hi")).withColumn("own", own).groupBy("doc_id", "key").agg(F.sum("own").cast("long").alias("hit"))
    found = hits.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "hit")
    ids = ids.select(F.col("doc_id").alias("d2"), F.col("key").alias("k2"), "ids")
    found = found.join(ids, (F.col("k") == F.col("k2")) & F.col("d").eqNullSafe(F.col("d2")))
    all_docs = index.postings.filter("tid = 0").select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    rows = all_docs.join(found, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    hit, ids = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    rows = rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that contamination() finds contaminated. Rows with a null doc_id are told apart by text."""
    named = docs.select(F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    d, h, x = (unused(docs, c) for c in ("d", "h", "x"))
    bad = contamination(named, items).filter("contaminated").select(F.col("doc_id.d").alias(d), F.col("doc_id.h").alias(h)).distinct()
    marked = docs.withColumn(x, F.xxhash64("text"))
    return marked.join(bad, (F.col(x) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_anti").select(docs.columns)
