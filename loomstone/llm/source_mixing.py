"""Mixing sources to target weights, by blocks of words.

The words of each source, document after document in a hashed order, are packed into blocks of
``block_words``. Each source has a quota of block draws that gives it its target in words. For each
output shard of ``shard_slots`` slots the sources' counts are multinomial, given their quotas: slot
number s draws the source in whose share of all slots the place of s in a pseudorandom permutation
lies. The draws of a source are numbered through all shards. Draw j of a source takes the block at
place j of a pseudorandom permutation of its blocks, another permutation each time the blocks are used
up, so that no block is taken more than one time more often than another. Blocks are joined by their
index. Permutations are keyed Feistel networks over any number of places (see ``with_permuted``).

Positions within a source are prefix sums over hashed buckets in two levels, and so are the numbers of
its draws over shards, so a source with a third of all rows is spread over many tasks. Rows that repeat
are counted before they move, and follow one another. All of it is DataFrame operations.

Edge cases: a null text has size 0; a null source is a source, the last in order. A source or table
without words has target 0 and takes nothing. Repeated rows are separate documents. An empty table
gives no rows. Further columns are kept by ``mixed_documents`` alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import number_in_group
from ._shared import stash

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, MOST_TIMES, SEED = 64, 4096, 3, 2024
WEIGHTS = (1, 2, 3)
#: Documents of a bucket on average, and buckets of a coarse bucket.
BUCKET_ROWS, COARSE = 64, 1024
#: Rounds of the Feistel network, and networks one after another for places that fall outside.
ROUNDS, WALKS = 6, 64
_NARROW = 256
#: Documents whose copies are broadcast, at most.
BROADCAST_ROWS = 500_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and th (hash of the text) of each row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"))


def source_targets(rows: DataFrame, *, most_times: int = MOST_TIMES) -> DataFrame:
    """rank, source, source_size, target of each source of rows (source, size).

    Sources fill up in order of cap by weight: those whose cap lies under the level that the rest
    share are at their cap, all others get their weight's share of what remains.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))).withColumn("cap", F.lit(float(most_times)) * F.col("source_size"))
    s = s.withColumn("all_words", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0.0))
    s = s.withColumn("level", (F.col("all_words") - before("cap")) / (F.col("all_weight") - before("weight"))).withColumn("capped", F.col("level") > F.col("cap") / F.col("weight"))
    left = F.col("all_words") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    share = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(left / share * F.col("weight"))).select("rank", "source", "source_size", "target")


def _before(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over rows of the same ``by`` with a smaller ``order`` (a long, once in each).

    COARSE numbers of the order at a time are summed first, so no window holds more than the coarse sums.
    """
    running = lambda c, *keys: F.sum(c).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col(c)
    fine = df.withColumn("_coarse", F.floor(F.col(order) / COARSE))
    wide = fine.groupBy(by, "_coarse").agg(F.sum(value).alias("_words"))
    wide = wide.select(by, "_coarse", running("_words", by, "_coarse").alias("_wide"))
    fine = fine.withColumn("_fine", running(value, by, "_coarse", order))
    return fine.join(wide, [by, "_coarse"]).withColumn(name, F.col("_wide") + F.col("_fine")).drop("_coarse", "_wide", "_fine")


def _placed(rows: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """Adds rank, source_size, target, key columns and ``at``, the words before the document in its source."""
    buckets = max(1, total // BUCKET_ROWS)
    same = rows.groupBy("source", "doc_id", "size", "th").agg(F.count("*").alias("copies"))
    r = same.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, same.source.eqNullSafe(sources.source)).drop(sources.source)
    r = r.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th", F.lit(SEED)), F.lit(buckets)).cast("long")).withColumn("words", F.col("size") * F.col("copies"))
    fine = _before(r.groupBy("rank", "bucket").agg(F.sum("words").alias("words")), "rank", "bucket", "words", "bucket_at").drop("words")
    order = Window.partitionBy("rank", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "th")
    r = r.withColumn("nth", F.row_number().over(order)).withColumn("own_at", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    r = r.join(fine, ["rank", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return r.withColumn("at", F.col("bucket_at") + F.col("own_at") + F.col("copy") * F.col("size"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def draws(spark: SparkSession, sources: DataFrame, *, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """rank, blocks, shard, first, past: the draws [first, past) that a shard makes from a source.

    ``sources`` has rank, blocks and quota. A shard's counts are a multinomial sample given the quotas:
    slots are dealt to sources by their places in one permutation of all slots. The thresholds that turn
    a place into a source are cut at ``_NARROW`` equal parts, by which slots and thresholds are joined.
    """
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    width = -(-max(1, slots) // _NARROW)
    upto = F.sum("quota").over(Window.orderBy("rank"))
    cut = sources.select("rank", "blocks", "quota", upto.alias("hi"), (upto - F.col("quota")).alias("lo")).where("quota > 0")
    thresholds = cut.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("part"))
    drawn = with_permuted(spark.range(0, slots), "place", F.col("id"), F.lit(max(1, slots)), F.lit(seed))
    drawn = drawn.select(F.floor(F.col("id") / shard_slots).alias("shard"), "place", F.floor(F.col("place") / width).alias("part"))
    counts = drawn.join(thresholds, (drawn.part == thresholds.part) & (drawn.place >= thresholds.lo) & (drawn.place < thresholds.hi)).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    counts = _before(counts, "rank", "shard", "n", "first").join(cut.select("rank", "blocks"), "rank")
    return counts.select("rank", "blocks", "shard", "first", (F.col("first") + F.col("n")).alias("past"))


def with_permuted(df: DataFrame, name: str, place: Column, places: Column, *key: Column) -> DataFrame:
    """Adds ``name``: where a keyed pseudorandom permutation of 0 .. places - 1 puts ``place``; all are longs.

    The places, written row by row into a table of about as many rows as columns, go through a Feistel
    network: the row number is shifted by a hash of the column and the column number by a hash of the
    row, ROUNDS times in all, modulo their own ranges. Fewer cells than one row are left over; a place
    that comes to lie there goes through the network again until it doesn't. A walk passes each left-over
    cell once at most, so WALKS are enough below WALKS ** 2 places, and beyond that the chance of a longer
    walk is under WALKS ** -WALKS.
    """
    at, all_places, rows, columns, a, b = (F.col(f"_{c}") for c in ("at", "places", "rows", "columns", "a", "b"))
    div = lambda x, y: F.call_function("div", x, y)
    down = lambda a, b, k: (a + F.pmod(F.xxhash64(*key, k, b), rows)) % rows
    across = lambda a, b, k: (b + F.pmod(F.xxhash64(*key, k, a), columns)) % columns
    kept = df.columns
    df = df.select("*", place.cast("long").alias("_at"), places.cast("long").alias("_places")).withColumn("_rows", F.floor(F.sqrt(all_places)).cast("long") + 1)
    df = df.withColumn("_columns", div(all_places + rows - 1, rows)).withColumn("_a", div(at, columns)).withColumn("_b", at % columns)
    for k in range(ROUNDS):
        df = df.withColumn("_b", across(a, b, F.lit(k))) if k % 2 else df.withColumn("_a", down(a, b, F.lit(k)))

    def again(x: Column) -> Column:
        turn = lambda s, k: F.when(k % 2 == 0, F.struct(down(s["a"], s["b"], k).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), across(s["a"], s["b"], k).alias("b")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(div(x, columns).alias("a"), (x % columns).alias("b")), turn, lambda s: s["a"] * columns + s["b"])

    df = df.withColumn("_at", a * columns + b)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), at, lambda x, _: F.when(x < all_places, x).otherwise(again(x)))
    return df.select(*kept, F.when(at < all_places, at).otherwise(walk).alias(name))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row."""
    return _taken(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """doc_id, source, th, copy (number among equal rows), size, source_size, target, taken of each row."""
    rows = stash(sizes(docs), "sizes")
    sources = stash(source_targets(rows, most_times=most_times), "sources")
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), most_times * blocks)).otherwise(F.lit(0))
    taken = draws(docs.sparkSession, sources.select("rank", blocks.alias("blocks"), quota.cast("long").alias("quota")), shard_slots=shard_slots, seed=seed)
    taken = taken.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard").select("rank", "blocks", F.explode(F.sequence("first", F.col("past") - 1)).alias("draw"))
    taken = with_permuted(taken, "block", F.pmod("draw", "blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.floor(F.col("draw") / F.col("blocks")))
    times = taken.groupBy("rank", "block").agg(F.count("*").alias("times"))
    placed = _placed(rows, sources, rows.count())
    covers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)))
    parts = placed.select("rank", "bucket", "nth", "copy", "doc_id", "source", "th", "size", "source_size", "target", "at", F.explode_outer(covers).alias("block"))
    within = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("at"), F.col("block") * block_words)
    met = parts.join(times, ["rank", "block"], "left").withColumn("words", F.coalesce(within * F.col("times"), F.lit(0)))
    return met.groupBy("rank", "bucket", "nth", "copy", "doc_id", "source", "th", "size", "source_size", "target").agg(F.sum("words").alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken/size times, rounded by a hash.

    Rows are told apart by doc_id, source and text. Those equal in all three are numbered, and share the
    times that all of them are taken as evenly as whole numbers can.
    """
    ratio = F.col("taken") / F.col("size") + _uniform(F.col("doc_id"), F.col("th"), F.col("copy"), F.lit(seed), F.lit(3))
    per = _taken(docs, seed=seed, **options).select("doc_id", "source", "th", F.when(F.col("size") > 0, F.floor(ratio)).otherwise(0).alias("times"))
    per = per.groupBy("doc_id", "source", "th").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    per = stash(per.select(F.struct("doc_id", "source", "th").alias("key"), "times", "rows"), "copies")
    few = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # names can't clash there
    same = F.col("row.doc_id").eqNullSafe(F.col("key.doc_id")) & F.col("row.source").eqNullSafe(F.col("key.source")) & (F.xxhash64("row.text") == F.col("key.th"))
    met = rows.join(F.broadcast(per) if few else per, same)
    once = met.where("rows = 1").select("row", "times")
    if per.where("rows > 1").limit(1).count():
        equal = number_in_group(met.where("rows > 1"), ["key"], ["row"], "nth")
        share = F.floor(F.col("times") / F.col("rows")) + (F.col("nth") < F.col("times") % F.col("rows")).cast("long")
        once = once.union(equal.select("row", share.alias("times")).where("times > 0"))
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
