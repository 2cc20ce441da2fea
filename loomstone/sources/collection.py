"""A stored, named collection of vectors with an inverted-list index.

Each vector lies in the list of its nearest centroid; the lists are folders of Parquet files. An upsert
writes new files for the lists that it touches alone (those that a replaced row leaves or a new one
enters), and a manifest that names, for every list, the folder that counts. A search looks through the lists of
the centroids nearest to a query and ranks their rows by exact similarity.

Centroids are fitted by k-means on at most ``FIT_ROWS`` vectors drawn by a hash; all vectors are indexed.
There are about as many lists as the square root of the number of rows, at most ``MOST_LISTS``, so what a
task holds of the index is bounded. How many lists a search has to look through for a wanted recall is
measured when the index is built, against exact searches for at most ``TRIAL_ROWS`` of its own rows, and kept.

Ids are longs and unique: of rows with the same id the last by order counts. Rows whose vector can't be
compared (null, empty, not finite) are kept in a list of their own (-1) and never found. All columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import HELD_NUMBERS, cell_search, matrix, nearest, usable
from . import versions
from .tables import write_and_read

FIT_ROWS, TRIAL_ROWS, MOST_LISTS = 100_000, 500, 4096
RECALL, TRIAL_K, ROUNDS = 0.95, 10, 8


def _nearest_lists(centres: np.ndarray, probes: int, name: str):
    """For rows (id, embedding): the ``probes`` lists nearest to each, in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD_NUMBERS // 8 // len(centres))  # similarities and their order, and a row for each list of a search
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            near = matrix(batch.column(1)) @ centres.T
            order = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(batch.num_rows), order.shape[1])
            place = np.tile(np.arange(order.shape[1]), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(order.ravel().astype(np.int32)), pa.array(place.astype(np.int32))], [name, "list", "place"])

    return work


class Collection:
    """A collection under a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = versions.Store(spark, self.path)

    # --- what is stored
    @property
    def version(self) -> int:
        return versions.current(self.store)

    def _entries(self) -> list:
        """A row for each list: list, folder, rows, centroids, probes."""
        return versions.manifest(self.spark, self.store).collect()

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its lists; with their list."""
        entries = [e for e in self._entries() if lists is None or e.list in set(lists)]
        folders = [f"{self.path}/{e.folder}/part={e.list}" for e in entries if e.rows]
        if folders:
            return self.spark.read.parquet(*folders)
        return self.spark.read.parquet(f"{self.path}/{self._entries()[0].shape}").limit(0)

    def _centres(self) -> tuple[np.ndarray, int]:
        first = self._entries()[0]
        rows = self.spark.read.parquet(f"{self.path}/{first.centroids}").orderBy("list").collect()  # MOST_LISTS at most
        return np.array([r.centre for r in rows]), first.probes

    # --- writes
    def _assigned(self, df: DataFrame, centres: np.ndarray) -> DataFrame:
        good = df.where(usable(F.col("embedding")))
        vectors = good.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
        own = vectors.mapInArrow(_nearest_lists(centres, 1, "id"), "id long, list int, place int").drop("place")
        return good.join(own, "id").unionByName(df.where(~usable(F.col("embedding"))).withColumn("list", F.lit(-1)))

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """Write rows (…, list) into a folder for each list; the folder, and list and rows of each."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("part", F.col("list")).hint("rebalance", "part").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").groupBy("list").agg(F.count("*").alias("rows"))

    def build(self, df: DataFrame, *, lists: int | None = None, order: str | None = None, seed: int = 1) -> "Collection":
        """Index rows (id, embedding, …) anew; what was there before no longer counts once all is written."""
        df = write_and_read(self._last(df, order), "build")
        good = df.where(usable(F.col("embedding")))
        n = good.count()
        wanted = max(1, min(MOST_LISTS, lists or round(n**0.5)))
        drawn = good.select(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("h").limit(FIT_ROWS)
        centres = self._fitted(write_and_read(drawn, "fit"), wanted, seed) if n else np.ones((1, 1))
        made = [(k, [float(x) for x in c]) for k, c in enumerate(centres)]
        centroids = f"centroids/{uuid.uuid4().hex}"
        self.spark.createDataFrame(made, "list int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/{centroids}")
        shape = f"shapes/{uuid.uuid4().hex}"
        df.limit(0).withColumn("list", F.lit(0)).coalesce(1).write.parquet(f"{self.path}/{shape}")
        folder, counts = self._write(self._assigned(df, centres))
        probes = self._calibrated(good, centres, seed)
        entries = counts.select("list", F.lit(folder).alias("folder"), "rows") if n or df.limit(1).count() else self.spark.createDataFrame([(0, folder, 0)], "list int, folder string, rows long")
        versions.publish(self.store, entries.select("list", "folder", "rows", F.lit(centroids).alias("centroids"), F.lit(shape).alias("shape"), F.lit(probes).alias("probes")), self.version + 1)
        return self

    rebuild = build  # in place of what is there

    def upsert(self, changes: DataFrame, *, order: str | None = None) -> int:
        """Insert or replace rows by id; the number of lists written. Other lists keep their files."""
        before, entries = self.version, self._entries()
        centres, _ = self._centres()
        last = self._last(changes, order)
        new = write_and_read(self._assigned(last.drop(order) if order and order not in self.rows([]).columns else last, centres), "upsert")
        left = self.rows().select("id", "list").join(new.select("id"), "id", "left_semi")
        touched = [r.list for r in left.select("list").union(new.select("list")).distinct().collect()]  # lists alone
        return self._replace(before, entries, touched, new.select("id"), new)

    def delete(self, ids: DataFrame) -> int:
        """Remove the rows of some ids (id); the number of lists written."""
        before, entries = self.version, self._entries()
        gone = write_and_read(ids.select(F.col("id").cast("long")).distinct(), "delete")
        touched = [r.list for r in self.rows().select("id", "list").join(gone, "id", "left_semi").select("list").distinct().collect()]
        return self._replace(before, entries, touched, gone, None)

    def _replace(self, before: int, entries: list, touched: list[int], ids: DataFrame, new: DataFrame | None) -> int:
        if not touched:
            return 0
        kept = self.rows(touched).join(ids, "id", "left_anti")
        folder, counts = self._write(kept if new is None else kept.unionByName(new.select(*kept.columns)))
        first = entries[0]
        same = [(e.list, e.folder, e.rows) for e in entries if e.list not in set(touched) and e.rows]
        after = counts.select("list", F.lit(folder).alias("folder"), "rows").union(self.spark.createDataFrame(same or [(0, folder, 0)], "list int, folder string, rows long"))
        versions.publish(self.store, after.select("*", F.lit(first.centroids).alias("centroids"), F.lit(first.shape).alias("shape"), F.lit(first.probes).alias("probes")), before + 1)
        return len(touched)

    def vacuum(self) -> int:
        """Remove data that the newest version doesn't use; the number of folders."""
        return versions.vacuum(self.spark, self.store, "data")

    @staticmethod
    def _last(df: DataFrame, order: str | None) -> DataFrame:
        payload = [c for c in df.columns if c != "id"]
        at = F.col(order) if order else F.xxhash64(*[F.col(c) for c in payload if df.schema[c].dataType.typeName() != "map"])
        last = df.groupBy(F.col("id").cast("long").alias("id")).agg(F.max_by(F.struct(*payload), at).alias("row"))
        return last.select("id", "row.*").where("id is not null")

    # --- the index
    def _fitted(self, drawn: DataFrame, lists: int, seed: int) -> np.ndarray:
        unit = drawn.where(F.exists("embedding", lambda x: x != 0)).select(array_to_vector("embedding").alias("features"))
        if not unit.limit(1).count():
            return np.ones((1, len(drawn.first().embedding)))
        model = KMeans(k=max(2, lists), maxIter=ROUNDS, seed=seed, distanceMeasure="cosine", initMode="random").fit(unit)
        centres = np.array(model.clusterCenters())
        return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def _calibrated(self, good: DataFrame, centres: np.ndarray, seed: int) -> int:
        """The number of nearest lists that hold RECALL of the TRIAL_K nearest rows of trial rows."""
        trial = write_and_read(good.select("id", "embedding").orderBy(F.xxhash64("id", F.lit(seed + 1))).limit(TRIAL_ROWS), "trial").withColumnRenamed("id", "query_id")
        near = write_and_read(nearest(trial, good.select("id", "embedding"), TRIAL_K), "near")
        every = trial.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_nearest_lists(centres, len(centres), "query_id"), "query_id long, list int, place int")
        own = self._assigned(good.join(near.select("id").distinct(), "id", "left_semi").select("id", "embedding"), centres).select("id", "list")
        places = near.join(own, "id").join(every, ["query_id", "list"])
        needed = places.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row for each list
        total, seen = sum(r.n for r in needed), 0
        for r in needed:
            seen += r.n
            if seen >= RECALL * total:
                return int(r.place) + 1
        return len(centres)

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, digits: int = 5) -> DataFrame:
        """query_id, id, similarity, rank of the k nearest rows to each query (query_id, embedding).

        ``probes`` lists are looked through (as measured when built, by default); with all of them it is exact.
        """
        centres, measured = self._centres()
        good = queries.where(usable(F.col("embedding"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        lists = good.mapInArrow(_nearest_lists(centres, probes or measured, "query_id"), "query_id long, list int, place int")
        wanted = good.join(lists, "query_id").select("query_id", F.col("list").alias("cell"), "embedding")
        return cell_search(wanted, self.rows().where("list >= 0").select("id", F.col("list").alias("cell"), "embedding"), k, digits=digits)
