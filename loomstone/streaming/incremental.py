"""Resumable ingestion: what is new since the last run is merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import BUCKETS, KeyedTable


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, *, name: str = "stream", deleted: Column | None = None) -> None:
    """Merge all that a streaming DataFrame has now into a keyed table, a batch at a time.

    The checkpoint remembers what has been read, the table which batches it holds: a batch that is run
    again after a loss, or after the checkpoint's last entry went, is merged once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, deleted=deleted, stream=name, batch=number)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, order: str, fmt: str = "json", *, buckets: int = BUCKETS) -> None:
    """Read new files under ``source`` and merge them by key into the keyed table ``target``."""
    merge_stream(spark.readStream.schema(schema).format(fmt).load(source), KeyedTable(spark, target, key, order, buckets=buckets), checkpoint, name=source)


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    return KeyedTable(spark, target, "", "").rows()


def retry_failed(failures: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Failures that can be tried again and haven't been done since."""
    return failures.where("retryable").join(done.select(key), key, "left_anti").select(key).distinct()


def with_error(df: DataFrame, value: str, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a value, and failures with whether they can be tried again."""
    low = F.lower(error)
    again = F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("429")) | F.contains(low, F.lit("temporarily")) | F.contains(low, F.lit("connection")) | low.rlike(r"\b5\d\d\b")
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull()).withColumn("retryable", again).withColumn("too_long", F.contains(low, F.lit("context length")))
