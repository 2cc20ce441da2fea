"""Sinks: documents as JSON, JSON lines, header texts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def header_texts(df: DataFrame, path: str, fields: list[str], body: str) -> None:
    """A text per row: KEY: value lines, 80 dashes, the body."""
    lines = [F.concat(F.lit(f"{f.upper()}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    df.select(F.concat_ws("\n", *lines, F.lit("-" * 80), F.col(body)).alias("value")).write.mode("overwrite").text(path)


def documents(rows: DataFrame, key: str, metadata: list[str], factoid: str, order: str) -> DataFrame:
    """A row per document: its metadata and factoids (id from 1 in order, text)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(factoid).alias("t"))))  # one document's
    grouped = rows.groupBy(key, *[c for c in metadata if c != key]).agg(parts.alias("_f"))
    numbered = F.transform("_f", lambda x, i: F.struct((i + 1).alias("id"), x["t"].alias("factoid_text")))
    return grouped.select(F.struct(*metadata).alias("metadata"), numbered.alias("factoids"))


def manifest(df: DataFrame, status: Column) -> DataFrame:
    """One row: all, and a map of counts by status."""
    counts = df.groupBy(status.alias("s")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("all"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("by_status"))  # a few statuses
