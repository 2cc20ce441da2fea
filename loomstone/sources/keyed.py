"""A keyed table that is merged in batches: hash buckets of files, a manifest, a log of what was merged.

A row lies in the bucket of its key's hash. A merge reads and writes the buckets of its own keys alone and
publishes a manifest that names the folder of every bucket (see ``versions``), so other buckets keep
their files, readers see a batch as a whole or not at all, and a merge that breaks off changes nothing.

Of a key's rows the one with the greatest order stays, whether it came early or late; between equals the
stored one stays, and within a batch the one whose other columns hash highest. So batches give the same
table in any order and however often they come. Deletions are kept as marks with their order until the
table is compacted, so that what comes late doesn't bring a row back.

The manifest also holds the last batch of each stream (the processed log): a batch that has been merged
is skipped, and a stream that starts again knows where it stood.

Keys and orders that are null are left out; keys are numbers or strings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .tables import write_and_read

BUCKETS = 64
_GONE = "_deleted"


class KeyedTable:
    """A keyed table under a folder of the shared store; made by the first merge."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, *, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.new_buckets = spark, path.rstrip("/"), key, order, buckets
        self.store = versions.Store(spark, self.path)

    @property
    def version(self) -> int:
        return versions.current(self.store)

    def entries(self, version: int | None = None) -> list:
        """bucket, folder, rows, buckets, marks, shape of each bucket: so many rows as there are buckets."""
        return versions.manifest(self.spark, self.store, version).collect() if self.version else []

    def merged(self) -> dict[str, int]:
        """The last batch of each stream."""
        found = self.entries()
        return dict(found[0].marks or {}) if found else {}

    def _read(self, entries: list) -> DataFrame:
        folders = [f"{self.path}/{e.folder}/part={e.bucket}" for e in entries if e.rows]
        shape = self.spark.read.parquet(f"{self.path}/{entries[0].shape}")
        return self.spark.read.schema(shape.schema).parquet(*folders) if folders else shape

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; without deleted ones."""
        entries = self.entries(version)
        if not entries:
            raise FileNotFoundError(f"nothing has been merged into {self.path}")
        return self._read(entries).where(~F.col(_GONE)).drop(_GONE)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def merge(self, changes: DataFrame, *, deleted: Column | None = None, stream: str | None = None, batch: int = 0) -> int:
        """Merge rows by key; the number of buckets written.

        ``deleted`` says which rows take their key away. A ``batch`` of a ``stream`` that isn't newer than
        the last one merged is skipped.
        """
        before, entries = self.version, self.entries()
        marks = dict(entries[0].marks or {}) if entries else {}
        if stream is not None and marks.get(stream, -1) >= batch:
            return 0
        buckets = entries[0].buckets if entries else self.new_buckets
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        marked = changes.withColumn(_GONE, gone).where(F.col(self.key).isNotNull() & F.col(self.order).isNotNull())
        columns = marked.columns
        hashed = [c for c in columns if marked.schema[c].dataType.typeName() not in ("map", "variant")]
        at = F.struct(F.col(self.order), F.xxhash64(*hashed))
        last = marked.groupBy(F.col(self.key).alias("key")).agg(F.max_by(F.struct(*columns), at).alias("row"))
        new = write_and_read(last.select("row.*"), "merge")
        touched = {r.bucket for r in new.select(self._bucket(buckets).alias("bucket")).distinct().collect()}  # buckets alone
        old = [e for e in entries if e.bucket in touched]
        if old:
            both = [df.select(F.col(self.key).alias("key"), F.struct(*columns).alias(name)) for df, name in ((self._read(old), "old"), (new, "new"))]
            stays = F.col("new").isNull() | (F.col(f"old.{self.order}") >= F.col(f"new.{self.order}"))
            new = both[0].join(both[1], "key", "full_outer").select(F.when(stays, F.col("old")).otherwise(F.col("new")).alias("row")).select("row.*")
        if stream is not None:
            marks[stream] = batch
        self._publish(before, new, buckets, [e for e in entries if e.bucket not in touched], entries[0].shape if entries else None, marks)
        return len(touched)

    def _publish(self, before: int, rows: DataFrame, buckets: int, others: list, shape: str | None, marks: dict[str, int]) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("part", self._bucket(buckets)).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/{folder}")
        if shape is None:
            shape = f"shapes/{uuid.uuid4().hex}"
            rows.limit(0).coalesce(1).write.parquet(f"{self.path}/{shape}")
        made = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").groupBy(self._bucket(buckets).alias("bucket")).agg(F.count("*").alias("rows"))
        same = [(e.bucket, e.folder, e.rows) for e in others if e.rows]
        columns = "bucket int, folder string, rows long"
        entries = made.select("bucket", F.lit(folder).alias("folder"), "rows").union(self.spark.createDataFrame(same, columns))
        if not same and not rows.limit(1).count():
            entries = self.spark.createDataFrame([(0, folder, 0)], columns)
        log = F.create_map(*[F.lit(x) for k, v in sorted(marks.items()) for x in (k, v)]) if marks else F.lit(None)
        versions.publish(self.store, entries.select("*", F.lit(buckets).alias("buckets"), log.cast("map<string,long>").alias("marks"), F.lit(shape).alias("shape")), before + 1)

    def compact(self, buckets: int | None = None) -> None:
        """Write all buckets anew, into another number of them if asked, without the marks of deleted rows."""
        before, entries = self.version, self.entries()
        if entries:
            rows = self._read(entries).where(~F.col(_GONE))
            self._publish(before, rows, buckets or entries[0].buckets, [], entries[0].shape, dict(entries[0].marks or {}))

    def vacuum(self, keep: int = 1) -> int:
        """Remove versions but the newest, and the files that only those used; the number of folders."""
        return versions.vacuum(self.spark, self.store, "data", keep=keep)
