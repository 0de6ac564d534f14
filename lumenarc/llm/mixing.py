"""Mixing sources to target weights, natively.

Each source's words form a stream, which is packed into blocks of a fixed length. Every slot of the output draws its
source by weight, which gives each output shard multinomial counts; a correction hands the few slots that a source drew
beyond its target to the sources that drew too few. The j-th slot of a source is mapped through a pseudorandom
permutation of the source's block numbers (a new one each time round), and joins the block of that number.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..workspace import materialize

WORDS = r"[^\x20\x09-\x0D]+"
CELLS = 4096
SLOTS_PER_TASK = 100_000
#: Shards whose counts are summed in one group, before the groups of a source are.
SHARDS_PER_GROUP = 4096


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def permuted(x: Column, n: Column, rounds: int, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at x, by the swap-or-not shuffle: exact for every n, no rejected values.

    In each round a keyed offset pairs the numbers up, and a keyed bit of the pair says whether its members swap.
    """
    offsets = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda k: F.pmod(F.xxhash64(k, *key), n))

    def swap(at: Column, offset: Column) -> Column:
        other = F.pmod(offset - at, n)
        return F.when(F.xxhash64(offset, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(offsets, x, swap)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Sources in code point order, null last, take the weights in turn. They share the sum of all sizes by weight, but a
    target stops at `most` times its source's size; what is over is shared anew among the others. That has a closed
    form: in the order of cap over weight, the first so many sources are capped, and one level holds for the rest.
    One row a source stands in these windows, not one a document.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("i", F.row_number().over(order))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    all_ = W.partitionBy(F.lit(1))
    upto = W.partitionBy(F.lit(1)).orderBy((F.col("cap") / F.col("weight")), "i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(all_).cast("double")).withColumn("w_all", F.sum("weight").over(all_))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    rows = rows.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level at the first source that is not capped holds for all that follow
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("q"), "i", "level"))).over(all_)
    rows = rows.withColumn("water", first["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _before(rows: DataFrame, value: str, bucket: str, order: list[str]) -> DataFrame:
    """rows, and in `before` the sum of value over the rows of their source that come earlier, by bucket, then by order.

    It is summed in two levels, first in the buckets, then over the buckets of a source, so a source with most of the
    rows is no single task.
    """
    inside = W.partitionBy("source", bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", bucket).agg(F.sum(value).alias("n"))
    sums = sums.select(F.col("source").alias("_s"), F.col(bucket).alias("_b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_base"))
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = own.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col(bucket) == F.col("_b")))
    return joined.withColumn("before", F.col("_base") + F.col("_own")).drop("_s", "_b", "_base", "_own")


def pack(docs: DataFrame, block: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_docs: int = 1_000) -> DataFrame:
    """(doc_id, source, size, start): where each document's words stand in its source's stream.

    The order is that of buckets by a hash of id and text, then of the hash, then of the id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), _hash(11, F.col(id_col), F.col(text_col)).alias("h"))
    rows = materialize(rows, "sizes")
    buckets = rows.count() // bucket_docs + 1
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return _before(rows, "size", "bucket", ["h", "doc_id", "size"]).select("doc_id", "source", "size", F.col("before").alias("start"))


def quotas(plan: DataFrame, block: int) -> DataFrame:
    """plan with blocks (of the source) and slots (that the mix takes from it, whole rounds and then part of one)."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    part = F.when(F.col("source_size") > 0, F.round(F.greatest(F.col("target") - rounds * F.col("source_size"), F.lit(0.0)) / F.col("source_size") * blocks)).otherwise(0)
    return plan.withColumn("blocks", blocks).withColumn("slots", (rounds * blocks + part).cast("long"))


def _intervals(rows: DataFrame, n: str, key: str) -> DataFrame:
    """rows (source, n) as intervals [lo, hi) in a row, one a source that has any."""
    upto = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(W.unboundedPreceding, 0)
    return rows.filter(F.col(n) > 0).withColumn("hi", F.sum(n).over(upto)).withColumn("lo", F.col("hi") - F.col(n))


def _find(points: DataFrame, at: str, spans: DataFrame, total: int) -> DataFrame:
    """Joins each point to the one interval that holds it: an equality on a cell of the line, then the bounds."""
    width = total // CELLS + 1
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("cell", F.floor(F.col(at) / width)).join(cells, "cell").filter((F.col("lo") <= F.col(at)) & (F.col(at) < F.col("hi"))).drop("cell")


def draw(plan: DataFrame, shard_slots: int = 4096, seed: int = 17, rounds: int = 16) -> DataFrame:
    """(shard, source, j, block, round): one row a slot of the mix; plan comes from quotas()."""
    spark = plan.sparkSession
    spans = materialize(_intervals(plan, "slots", "source").select("source", "blocks", "slots", "lo", "hi"), "spans")
    total = int(spans.agg(F.sum("slots")).first()[0] or 0)
    slots = spark.range(total).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(_hash(seed, F.col("id")), F.lit(max(total, 1))).alias("u"))
    drawn = _find(slots, "u", spans, total).groupBy("shard", "source", "blocks", "slots").agg(F.count("*").alias("n"))  # multinomial counts a shard
    drawn = materialize(drawn, "drawn")
    drawn = _before(drawn.withColumn("group", F.floor(F.col("shard") / SHARDS_PER_GROUP)), "n", "group", ["shard"]).withColumnRenamed("before", "base")
    # the sums deal by source and group; slots are made by shard, so that a source with most of them is no single task
    drawn = drawn.repartition(min(10_000, total // SLOTS_PER_TASK + 1), "shard")
    taken = drawn.withColumn("j", F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)))
    kept = taken.filter("j < slots").select("shard", "source", "blocks", "j")
    # the correction: surplus slots, in order, go to what is missing, in order
    got = drawn.groupBy("source").agg(F.sum("n").alias("got"))
    off = materialize(spans.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "blocks", "slots", F.coalesce("got", F.lit(0)).alias("got")), "off")
    over = _intervals(off.withColumn("d", F.col("got") - F.col("slots")), "d", "source").select(F.col("source").alias("s"), F.col("slots").alias("quota"), F.col("lo").alias("from"))
    spare = taken.filter("j >= slots").join(over, F.col("source").eqNullSafe(F.col("s"))).select("shard", (F.col("from") + F.col("j") - F.col("quota")).alias("x"))
    under = _intervals(off.withColumn("d", F.col("slots") - F.col("got")), "d", "source").select("source", "blocks", "got", "lo", "hi")
    missing = int(under.agg(F.max("hi")).first()[0] or 0)
    given = _find(spare, "x", under, missing).select("shard", "source", "blocks", (F.col("got") + F.col("x") - F.col("lo")).alias("j"))
    rows = kept.unionByName(given).withColumn("round", (F.col("j") / F.col("blocks")).cast("long"))
    at = permuted(F.col("j") - F.col("round") * F.col("blocks"), F.col("blocks"), rounds, F.coalesce(F.col("source"), F.lit("\0")), F.col("round"), F.lit(seed))
    return rows.select("shard", "source", "j", at.alias("block"), "round")


def spans_of_blocks(packed: DataFrame, block: int = 64) -> DataFrame:
    """(doc_id, source, block, from_word, words): the part of each document that lies in each block."""
    rows = packed.filter("size > 0").withColumn("block", F.explode(F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long"))))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("doc_id", "source", "size", "start", "block", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("words"))


def mix(docs: DataFrame, block: int = 64, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed, plan, slots): the streams, the targets and the mix itself, see pack(), quotas() and draw()."""
    packed = materialize(pack(docs, block), "packed")
    plan = materialize(quotas(targets(packed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), block), "plan")
    return packed, plan, draw(plan)


def mixed_documents(docs: DataFrame, block: int = 64, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    A null or empty text has size 0 and nothing is taken of it. A null source is a source, the last one. Rows that repeat
    an id are documents of their own; those alike in id and text may swap places. A source's slots make its target to
    within half a block, and no document is taken more than `most` times, because no block is. A source of size 0 has the
    target 0. An empty table gives an empty result; other columns are not read. Reruns agree: every draw is a hash.
    """
    packed, plan, slots = mix(docs, block, weights, most)
    takes = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"))
    parts = spans_of_blocks(packed, block).join(takes, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    # a document's place in its stream names it, whatever its id
    words = parts.groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    found = packed.join(words, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left").drop("s", "at")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target")
    return found.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
