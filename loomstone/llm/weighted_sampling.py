"""Document fingerprints by consistent weighted sampling.

A text is its lower-cased words (parted by ASCII white space) with their counts as weights. For each of
``SAMPLES`` samples every weighted term gets, from hashed uniform numbers that depend on term and
sample alone, r and c from Gamma(2, 1) and b from U(0, 1); with t = floor(ln(weight)/r + b) its value
is ln c - r (t - b + 1), and the least term and its t are the sample. Two texts agree in a sample with
the probability of their generalised Jaccard similarity: sum of minima by sum of maxima of weights.
A fingerprint is 8 hex digits of each sample's (term, t); likeness is the share that agrees.

Documents move between tasks once, by their key; terms are counted and sampled where they are. The
next document is found with a range partitioning of ids and the partitions' first ids. All of it is
DataFrame operations on the built-in hash and logarithm.

Edge cases: a null text is empty; texts without words have a fingerprint of zeros and are alike with
each other alone. Documents are ordered by doc_id (null first), then by a hash of the text; rows that
repeat both are one document, returned as often. A lone document is its own next. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stash

SAMPLES, GROUP = 48, 3
SPACE = r"[\x20\x09-\x0D]+"
_LEAST_ID = -(1 << 63)
#: Hex digits of the digest that one long carries through the aggregation.
_DIGITS = 13


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))


def with_next(docs: DataFrame) -> DataFrame:
    """dk, th, n_chars, copies, ndk, nth: each different document and the key of the next."""
    spark = docs.sparkSession
    ids = _keyed(docs).groupBy("dk", "th").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stash(ids.repartitionByRange(parts, "dk", "th").withColumn("part", F.spark_partition_id()), "ids")
    firsts = placed.groupBy("part").agg(F.min(F.struct("dk", "th")).alias("first"))
    by_part = Window.orderBy("part")  # a row per partition
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    within = F.lead(F.struct("dk", "th")).over(Window.partitionBy("part").orderBy("dk", "th")).alias("next")
    after = placed.select("dk", "th", "n_chars", "copies", "part", within).join(F.broadcast(firsts), "part")
    after = after.withColumn("next", F.coalesce("next", "after"))
    return stash(after.select("dk", "th", "n_chars", "copies", F.col("next.dk").alias("ndk"), F.col("next.th").alias("nth")), "pairs")


def edited_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """dk, th, text, edited, same (characters before the edit) of each different document, partitioned by its key."""
    once = Window.partitionBy("dk", "th").orderBy("th")
    texts = _keyed(docs).withColumn("nth_copy", F.row_number().over(once)).where("nth_copy = 1").drop("nth_copy")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = pairs.select(F.col("dk").alias("pdk"), F.col("th").alias("pth"), F.col("ndk").alias("dk"), F.col("nth").alias("th"), "n_chars")
    heads = texts.join(wanted, ["dk", "th"]).select(F.col("pdk").alias("dk"), F.col("pth").alias("th"), "n_chars", F.substring("text", F.lit(1), cut).alias("head"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), "head")
    return texts.join(heads, ["dk", "th"]).select("dk", "th", "text", edited.alias("edited"), (F.col("n_chars") - cut).cast("int").alias("same"))


def _unit(bits: Column, width: int) -> Column:
    """A number in (0, 1) from an integer below 2**width."""
    return (bits.cast("double") + 0.5) * (1.0 / (1 << width))


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _ln(x: Column) -> Column:
    """ln of a number above 0; the type then has no null, which keeps the generated code short."""
    return F.coalesce(F.log(x), F.lit(0.0))


def _sample_values(rows: DataFrame) -> DataFrame:
    """For rows (…, term, n, weight, block): v_i, the packed values of the block's samples; null where a
    value can't be the least.

    A packed value orders by ln c - r (t - b + 1), in steps of 2**-23, and carries 32 bits of term and t;
    two terms that differ are taken for one another with a chance of 2**-32. With c = -ln p and
    r = -ln q, exp of the value is at least (1 - p) q / n, while the least of a text of that weight
    exceeds 40 / weight with a chance of exp(-40): terms above that need no logarithm. GROUP samples at a
    time stay below the size of method that the JVM compiles.
    """
    keep = [c for c in rows.columns if c not in ("term", "n", "ln_n", "weight")]
    hashes, drawn, bound, logs, steps, out = [], [], [], [], [], []
    for i in range(GROUP):
        hashes += [F.xxhash64("seed", F.lit(2 * i + k)).alias(f"{'xy'[k]}{i}") for k in (0, 1)]
        x, y = F.col(f"x{i}"), F.col(f"y{i}")
        drawn += [
            (_unit(_low(x, 32), 32) * _unit(F.shiftrightunsigned(x, 32), 32)).alias(f"q{i}"),
            (_unit(_low(y, 24), 24) * _unit(_low(F.shiftrightunsigned(y, 24), 24), 24)).alias(f"p{i}"),
            _unit(F.shiftrightunsigned(y, 48), 16).alias(f"b{i}"),
        ]
        r, c, b, t, p, q, least = (F.col(f"{n}{i}") for n in "rcbtpqm")
        bound.append(((1.0 - p) * q * F.col("weight") < 40.0 * F.col("n")).alias(f"m{i}"))
        logs += [F.when(least, -_ln(q)).otherwise(1.0).alias(f"r{i}"), F.when(least, _ln(-_ln(p))).otherwise(0.0).alias(f"c{i}")]
        steps.append(F.floor(F.coalesce(F.col("ln_n") / r, F.lit(0.0)) + b).alias(f"t{i}"))
        fixed = F.floor((c - r * (t - b + 1.0) + 128.0) * float(1 << 23))  # above 0: r is under 46, c above -17, ln(weight) under 44
        out.append(F.when(least, F.shiftleft(fixed, 32).bitwiseOR(_low(F.col("term").bitwiseXOR(F.shiftleft(t, 5) + t), 32))).alias(f"v{i}"))
    marks = [f"m{i}" for i in range(GROUP)]
    rows = rows.withColumn("seed", F.xxhash64("term", "block"))
    rows = rows.select(*keep, "term", "n", "ln_n", "weight", *hashes)
    rows = rows.select(*keep, "term", "n", "ln_n", "weight", *drawn)
    rows = rows.select(*keep, "term", "ln_n", *[f"{k}{i}" for i in range(GROUP) for k in "qpb"], *bound)
    rows = rows.select(*keep, "term", "ln_n", *[f"b{i}" for i in range(GROUP)], *marks, *logs)
    rows = rows.select(*rows.columns, *steps)
    return rows.select(*keep, *out)


def fingerprints(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """dk, th, s0, s1 (arrays of packed samples of text and edited), edited_sha256."""
    blocks = samples // GROUP
    sha = F.sha2("edited", 256)
    cuts = range(0, 64, _DIGITS)
    digits = [F.conv(F.substring(sha, k + 1, _DIGITS), 16, 10).cast("long").alias(f"h{k}") for k in cuts]
    # words up to the last white space before the edit count for both texts, and are split once
    ready = texts.select("dk", "th", *digits, F.lower("text").alias("text"), F.lower("edited").alias("edited"), F.length(F.regexp_extract(F.left("text", "same"), r"(?s)^.*[\x20\x09-\x0D]", 0)).alias("shared"))
    rest = lambda c: F.substring(c, F.col("shared") + 1, F.length(c))
    ready = ready.select("dk", "th", *[f"h{k}" for k in cuts], F.split(F.left("text", "shared"), SPACE).alias("w0"), F.split(rest("text"), SPACE).alias("w1"), F.split(rest("edited"), SPACE).alias("w2"))
    # what both texts weigh at least; each part has an empty word at either end at most
    weight = F.greatest(F.size("w0") + F.least(F.size("w1"), F.size("w2")) - 4, F.lit(0)).cast("long")
    pieces = ready.select("dk", "th", *[f"h{k}" for k in cuts], weight.alias("weight"), "w0", "w1", "w2")
    pieces = pieces.select("dk", "th", "weight", *[f"h{k}" for k in cuts], F.posexplode(F.array("w0", "w1", "w2")).alias("piece", "words"))
    words = pieces.select("dk", "th", "weight", "piece", *[f"h{k}" for k in cuts], F.posexplode("words").alias("pos", "word"))  # what stands beside a generator is computed for each of its rows
    term = F.when(F.col("word") != "", F.xxhash64("word")).alias("term")
    counted = words.select("dk", "th", "weight", term, (F.col("piece") < 2).cast("long").alias("n0"), (F.col("piece") != 1).cast("long").alias("n1"), *[F.when((F.col("piece") == 0) & (F.col("pos") == 0), F.col(f"h{k}")).alias(f"h{k}") for k in cuts])
    counted = counted.groupBy("dk", "th", "term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("weight").cast("double").alias("weight"), *[F.max(f"h{k}").alias(f"h{k}") for k in cuts])
    # a term that weighs the same on either side is sampled once; bit 1 is for the text, bit 2 for the edited text
    ints = lambda *x: F.array(*map(F.lit, x))
    sides = F.when(F.col("term").isNull(), ints(0)).when(F.col("n0") == F.col("n1"), ints(3)).when(F.col("n0") == 0, ints(2)).when(F.col("n1") == 0, ints(1)).otherwise(ints(1, 2))
    weighed = counted.select("dk", "th", F.coalesce("term", F.lit(0).cast("long")).alias("term"), "n0", "n1", "weight", *[f"h{k}" for k in cuts], F.explode(sides).alias("sides"))
    weighed = weighed.select("dk", "th", "term", "weight", F.when(F.col("sides") == 2, F.col("n1")).otherwise(F.col("n0")).cast("double").alias("n"), "sides", *[f"h{k}" for k in cuts])
    weighed = weighed.select("*", _ln(F.col("n")).alias("ln_n"))
    weighed = weighed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    of = lambda s, i: F.min(F.when(F.col("sides").bitwiseAND(F.lit(1 << s)) != 0, F.col(f"v{i}")))
    least = _sample_values(weighed).groupBy("dk", "th", "block").agg(*[of(s, i).alias(f"v{s}_{i}") for s in (0, 1) for i in range(GROUP)], *[F.max(f"h{k}").alias(f"h{k}") for k in cuts])
    packed = F.struct("block", *[F.array(*[F.coalesce(f"v{s}_{i}", F.lit(0).cast("long")) for i in range(GROUP)]).alias(f"s{s}") for s in (0, 1)])
    whole = least.groupBy("dk", "th").agg(F.array_sort(F.collect_list(packed)).alias("p"), *[F.max(f"h{k}").alias(f"h{k}") for k in cuts])  # a row per block
    hexed = F.concat(*[F.lpad(F.lower(F.hex(f"h{k}")), min(_DIGITS, 64 - k), "0") for k in cuts])
    return whole.select("dk", "th", *[F.flatten(F.col(f"p.s{s}")).alias(f"s{s}") for s in (0, 1)], hexed.alias("edited_sha256"))


def _hex(samples: str) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """The share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    pairs = with_next(docs)
    marks = stash(fingerprints(edited_texts(docs, pairs), samples), "fingerprints")
    ahead = marks.select(F.col("dk").alias("ndk"), F.col("th").alias("nth"), F.col("s0").alias("next"))
    met = pairs.join(marks, ["dk", "th"]).join(ahead, ["ndk", "nth"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return met.select(
        F.when(F.col("dk") != _LEAST_ID, F.col("dk")).alias("doc_id"), "n_chars", "edited_sha256", _hex("s0").alias("fingerprint"), _hex("s1").alias("edited_fingerprint"),
        likeness("s0", "s1").alias("near_edited"), likeness("s0", "next").alias("near_next"),
    )


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
