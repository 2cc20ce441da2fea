"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC for stable timestamps, adaptive execution for skew and partition counts, last key wins in maps.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "loomstone", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to as many tasks as a shuffle has: a small file, which few tasks read, may stand for much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
