"""Tables in the shared store: lineage cuts, keyed merges, updates of what exists."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex
_roots: set[str] = set()


def shared_base(spark: SparkSession) -> str:
    """The store that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset.

    A warehouse in a folder of one machine serves a local master alone; on a cluster it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if base.startswith(("file:", "/")) and not master.startswith(("local[", "local-cluster[")) and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared store; all such folders of a session are removed when Python ends."""
    root = f"{shared_base(spark)}/loomstone-tables-{_RUN}"
    if root not in _roots:
        _roots.add(root)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        atexit.register(_remove, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    return f"{root}/{uuid.uuid4().hex}"


def _remove(path, store) -> None:
    try:
        store.delete(path, True)
    except Exception:  # noqa: BLE001 the session's JVM has ended before, and with it the way to the store
        return


def write_and_read(df: DataFrame, tag: str = "table") -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}-{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, key: str, *order: str, tag: str = "table") -> DataFrame:
    """The rows as a table in n buckets by key, sorted by key and order, read back.

    Rows that lie by key in n partitions already give a file a bucket. The table is kept by its folder in
    the shared store; the catalog holds its name only while it is opened.
    """
    spark = df.sparkSession
    name = f"loomstone_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}-{tag}"
    df.write.bucketBy(n, key).sortBy(key, *order).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    made = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return made


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace by key; of a key's changes the last by order counts. Columns as in target."""
    payload = [c for c in target.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_new"))
    met = target.select(F.col(key), F.struct(*payload).alias("_old")).join(last, key, "full_outer")
    return met.select(key, F.coalesce("_new", "_old").alias("_row")).select(key, "_row.*")


def update_existing(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The target with columns replaced where changes (a row per key) has the key; changes without a row."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    met = target.join(new, key, "left")
    done = met.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])
    return done, changes.join(target.select(key), key, "left_anti")


def suffixed_ids(df: DataFrame, id_col: str, place: str) -> DataFrame:
    """Rows whose id an earlier row (by place) has get their place as suffix; the first keeps its own.

    The first place of an id is an aggregate, so rows of a common id stay where they are.
    """
    first = df.groupBy(F.col(id_col).alias("_id")).agg(F.min(place).alias("_first"))
    met = df.join(first, F.col(id_col) == F.col("_id"))
    own = F.when(F.col(place) > F.col("_first"), F.concat_ws("_", id_col, F.col(place).cast("string"))).otherwise(F.col(id_col))
    return met.withColumn(id_col, own).select(df.columns)


def split_write(df: DataFrame, path: str, route: Column, name: str = "route") -> DataFrame:
    """Write partitioned by a route and return the count of each."""
    df.withColumn(name, route).write.mode("overwrite").partitionBy(name).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(name).agg(F.count("*").alias("n"))
