"""Difference of two snapshots of a table, with rows found again under another key.

Both snapshots are written as tables bucketed and sorted by key, one file a bucket, so they meet in a
merge join without an exchange. Rows that no equal key pairs are written again, bucketed and sorted by
a digest of their content and their rank within it, and meet in a second merge join: the i-th smallest
earlier key of a content pairs with the i-th smallest later key, after the contents themselves have been
compared. Ranks come from range partitions (see ``number_in_group``), so a content that a third of
all rows share is spread over many tasks, buckets included.

Edge cases: a null content pairs with null contents only, an empty one with empty ones. A key that a
snapshot repeats (null keys are one such key) has its rows numbered by content digest and the other
columns, and equal numbers pair; what is left over is unpaired. Equal rows are interchangeable. An
empty snapshot makes all rows inserts or deletes. Columns beside key and ``columns`` are ignored, so
their names can't clash. Keys are numbers or strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import number_in_group
from ._shared import let_go, new_folder, stash

KEY, CONTENT, COLUMNS = "doc_id", "text", ("text", "lang", "source")
_ID = ("k", "nth")


def _digest(content: Column) -> Column:
    """32 bytes of a content; null has none of a text's."""
    return F.coalesce(F.unhex(F.sha2(content, 256)), F.unhex(F.lit("00" * 32)))


def _bucketed(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """The rows as a table bucketed and sorted by columns, a file for each bucket, read back.

    There are as many buckets as shuffle partitions, so the exchange before the write deals out whole
    buckets. The table is kept by its folder in the shared store; the catalog holds its name only while
    it is opened. The exchange's files go when the driver has forgotten the write.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"loomstone_{tag}_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", new_folder(spark, tag)).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    let_go(spark)
    return table


def _keyed(snapshot: DataFrame, key: str, content: str, columns: Sequence[str]) -> DataFrame:
    """k (never null), nth, key, digest and row (the columns) of each row; (k, nth) is unique.

    nth is 0 for keys that stand once, counts the rows of repeated keys, and is below 0 for null keys.
    """
    none = F.lit("0").cast(snapshot.schema[key].dataType)
    rows = snapshot.select(
        F.coalesce(F.col(f"`{key}`"), none).alias("k"), F.when(F.col(f"`{key}`").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("nth"), F.col(f"`{key}`").alias("key"),
        _digest(F.col(f"`{content}`")).alias("digest"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
    )
    repeated = snapshot.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        others = [f"c{i}" for i, c in enumerate(columns) if c != content]
        rows = number_in_group(rows.drop("nth"), "key", ["digest", *others], "nth")
        rows = rows.withColumn("nth", F.when(F.col("key").isNull(), -1 - F.col("nth")).otherwise(F.col("nth")))
    cells = [f"c{i}" for i in range(len(columns))]
    return rows.select("k", "nth", "key", "digest", *cells)


def _struct(side: str, columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"{side}.c{i}").alias(c) for i, c in enumerate(columns)])


def _changed(columns: Sequence[str]) -> Column:
    """The names of the columns that differ, in order."""
    return F.concat_ws(",", *[F.when(~F.col(f"a.c{i}").eqNullSafe(F.col(f"b.c{i}")), F.lit(c)) for i, c in enumerate(columns)])


def snapshot_diff(earlier: DataFrame, later: DataFrame, *, key: str = KEY, content: str = CONTENT, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """key, old_key, op, changed, old, new of each pair and each unpaired row.

    op is same or update for equal keys, rekey for rows found by content under another key, else insert
    or delete; old and new are structs of ``columns``, null where there is no such row. ``changed`` names
    the columns that differ, joined by commas.
    """
    a = _bucketed(_keyed(earlier, key, content, columns), "earlier", *_ID)
    b = _bucketed(_keyed(later, key, content, columns), "later", *_ID)
    sides = [df.select(*_ID, "key", "digest").alias(s) for df, s in ((a, "a"), (b, "b"))]
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _ID]
    only = lambda x, y: x.join(y.hint("merge"), met, "left_anti")
    alone = only(*sides).withColumn("side", F.lit(0)).union(only(*sides[::-1]).withColumn("side", F.lit(1)))
    order = [F.col("key").isNull().alias("no_key")]
    ranked = number_in_group(alone.select("side", "digest", *order, "k", "nth", "key"), ["side", "digest"], ["no_key", "k", "nth"], "place")
    ranked = stash(ranked.select("side", "k", "nth", "place"), "places")

    def unpaired(table: DataFrame, side: int, tag: str) -> DataFrame:
        places = _bucketed(ranked.where(F.col("side") == side).select("k", "nth", "place"), f"{tag}_places", *_ID)
        return _bucketed(table.join(places.hint("merge"), list(_ID)), tag, "digest", "place")

    c, d = unpaired(a, 0, "gone"), unpaired(b, 1, "come")
    pairs = a.alias("a").join(b.alias("b").hint("merge"), met).select(
        F.col("b.key").alias("key"), F.col("a.key").alias("old_key"), F.when(_changed(columns) == "", "same").otherwise("update").alias("op"), _changed(columns).alias("changed"),
        _struct("a", columns).alias("old"), _struct("b", columns).alias("new"),
    )
    at = list(columns).index(content)
    both = c.alias("a").join(d.alias("b").hint("merge"), [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("digest", "place")], "full_outer")
    equal = F.col(f"a.c{at}").eqNullSafe(F.col(f"b.c{at}")) & F.col("a.k").isNotNull() & F.col("b.k").isNotNull()  # the contents themselves
    old, new, nothing = _struct("a", columns), _struct("b", columns), F.lit(None)
    kind = earlier.schema[key].dataType
    row = lambda k, o, op, changed, x, y: F.struct(k.alias("key"), o.cast(kind).alias("old_key"), F.lit(op).alias("op"), changed.alias("changed"), x.alias("old"), y.alias("new"))
    as_struct = lambda x: nothing.cast(_type(x, both))
    rekeyed = row(F.col("b.key"), F.col("a.key"), "rekey", _changed(columns), old, new)
    gone = row(F.col("a.key"), F.col("a.key"), "delete", F.lit(""), old, as_struct(new))
    come = row(F.col("b.key"), nothing, "insert", F.lit(""), as_struct(old), new)
    rest = both.select(F.when(equal, F.array(rekeyed)).when(F.col("b.k").isNull(), F.array(gone)).when(F.col("a.k").isNull(), F.array(come)).otherwise(F.array(gone, come)).alias("rows"))
    return pairs.union(rest.select(F.explode("rows").alias("r")).select("r.*"))


def _type(c: Column, df: DataFrame):
    return df.select(c.alias("x")).schema["x"].dataType


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot of the query: documents dropped, edited, moved to other keys and copied by their key's crc32."""
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16
    kept = docs.select("doc_id", "text", "lang", "source", bucket.alias("bucket")).where("bucket IS NULL OR bucket <> 0")
    moved = -1 - F.col("doc_id")
    one = lambda i, t, n, s: F.struct(i.alias("doc_id"), t.alias("text"), n.alias("lang"), s.alias("source"))
    i, t, n, s = (F.col(c) for c in ("doc_id", "text", "lang", "source"))
    b = F.col("bucket")
    rows = (
        F.when(b == 1, F.array(one(i, F.concat(F.coalesce(t, F.lit("")), F.lit("+")), n, s)))
        .when(b == 2, F.array(one(i, t, s, n)))
        .when(b == 3, F.array(one(moved, t, n, s)))
        .when(b == 4, F.array(one(moved, t, n, F.lit(None).cast("string"))))
        .when(b == 5, F.array(one(i, t, n, s), one(moved, t, n, s)))
        .otherwise(F.array(one(i, t, n, s)))
    )
    return kept.select(F.explode(rows).alias("r")).select("r.*")


def op11_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = snapshot_diff(docs, later_snapshot(docs))
    new = lambda c: F.coalesce(F.col(f"new.{c}"), F.lit("~"))
    row = F.when(F.col("new").isNotNull(), F.sha2(F.concat(new("text"), F.lit("\n"), new("lang"), F.lit("\n"), new("source")), 256))
    return out.select("key", "old_key", "op", "changed", row.alias("row_sha256"))


_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, c: list_reduce(range(8), lambda x, i: {_BIT}, xor(r, c)), CAST(4294967295 AS BIGINT)), 4294967295)"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, text, lang, source, {_CRC} % 16 AS m FROM documents),
 later AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
   CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM d WHERE m <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM d WHERE m = 5),
 l AS (SELECT *, text IS NULL AS t0 FROM later), e AS (SELECT doc_id AS k, text, lang, source FROM documents),
 gone AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM e WHERE k NOT IN (SELECT k FROM l)),
 come AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM l WHERE k NOT IN (SELECT k FROM e)),
 met AS (SELECT e.k AS ok, l.k AS nk, 'k' AS how, e.text AS ot, l.text AS nt, e.lang AS ol, l.lang AS nl, e.source AS os, l.source AS ns FROM e JOIN l ON e.k = l.k
  UNION ALL SELECT a.k, b.k, 'c', a.text, b.text, a.lang, b.lang, a.source, b.source FROM gone a FULL JOIN come b ON a.text IS NOT DISTINCT FROM b.text AND a.i = b.i),
 named AS (SELECT *, CASE WHEN ok IS NULL OR nk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) END AS changed FROM met)
SELECT coalesce(nk, ok) AS key, ok AS old_key, CASE WHEN ok IS NULL THEN 'insert' WHEN nk IS NULL THEN 'delete' WHEN how = 'c' THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
 CASE WHEN nk IS NOT NULL THEN sha256(coalesce(nt, '~') || chr(10) || coalesce(nl, '~') || chr(10) || coalesce(ns, '~')) END AS row_sha256 FROM named
"""
