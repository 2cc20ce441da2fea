"""Checks as queries: a row per violation, counts per status, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """id, rule of each rule that a row breaks (a rule is the condition that holds for good rows)."""
    broken = [F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items()]
    return df.select(id_col, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def histogram(df: DataFrame, label: Column | str, name: str = "label") -> DataFrame:
    key = label if isinstance(label, Column) else F.col(label)
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def with_total(df: DataFrame, key: str, total: str = "TOTAL") -> DataFrame:
    """Counts per key and one row of all."""
    counts = df.groupBy(F.coalesce(F.col(key), F.lit("")).alias(key)).agg(F.count("*").alias("n"))
    return counts.union(df.agg(F.lit(total).alias(key), F.count("*").alias("n")))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key), key, "left_anti")


def processed_counts(df: DataFrame, file_col: str, total: int) -> DataFrame:
    done = F.countDistinct(F.nullif(F.trim(F.col(file_col)), F.lit("")))
    return df.agg(done.alias("processed"), F.greatest(F.lit(total) - done, F.lit(0)).alias("remaining"))
