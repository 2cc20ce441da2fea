"""A pipeline of named stages over tables: skip what is complete, run, validate, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    #: Rules by name that a row count fulfils: (rows of the stage, rows of earlier stages) -> good.
    checks: dict[str, Callable[[int, dict[str, int]], bool]] = field(default_factory=dict)


@dataclass
class Report:
    name: str
    status: str
    rows: int
    failed: list[str]


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run(spark: SparkSession, stages: list[Stage], folder: str, *, force: bool = False, validate_only: bool = False) -> list[Report]:
    """Write each stage's table under ``folder``; stop at the first that fails its checks."""
    tables: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    reports = []
    for stage in stages:
        path, status = f"{folder}/{stage.name}", "skipped"
        if not validate_only and (force or not _complete(spark, path)):
            stage.build(spark, tables).write.mode("overwrite").parquet(path)
            status = "run"
        if not _complete(spark, path):
            reports.append(Report(stage.name, "missing", 0, []))
            break
        tables[stage.name] = spark.read.parquet(path)
        counts[stage.name] = tables[stage.name].count()
        failed = [name for name, good in stage.checks.items() if not good(counts[stage.name], counts)]
        reports.append(Report(stage.name, "failed" if failed else status, counts[stage.name], failed))
        if failed:
            break
    return reports
