"""Duplicates by key, reports of groups, and greedy canonical clusters over neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..sources.tables import write_and_read
from .match import keep_first


def text_key(c: Column, fold: bool = True) -> Column:
    """White space collapsed; with ``fold`` lower case and ß as ss."""
    out = squeeze(c)
    return F.replace(F.lower(out), F.lit("ß"), F.lit("ss")) if fold else out


def dedupe_by_key(df: DataFrame, key: Column, order: str, within: list[str] | None = None) -> DataFrame:
    """The first row, by order, of each key (of each ``within``)."""
    return keep_first(df.withColumn("_key", key), [*(within or []), "_key"], order).drop("_key")


def duplicate_report(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """canonical_id, duplicate_id, members: a row for each id after the first of its group.

    Keys are computed and written once; groups are counted with partial aggregation and met by a join, so
    no row or task holds a group.
    """
    keyed = write_and_read(df.select(F.col(id_col).alias("duplicate_id"), key.alias("_key")), "keyed")
    groups = keyed.groupBy("_key").agg(F.min("duplicate_id").alias("canonical_id"), F.count("*").alias("members")).where("members > 1")
    return keyed.join(groups, "_key").where("duplicate_id > canonical_id").select("canonical_id", "duplicate_id", "members")


def reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, (1 - after / before) * 100).otherwise(0.0)


def greedy_canonical(nodes: DataFrame, edges: DataFrame, stash) -> DataFrame:
    """id, root: what a pass in id order gives that attaches to each canonical id its near, free neighbours.

    edges: (src, dst) with src < dst, dst in the neighbour list of src. An id is canonical if all of its
    in-neighbours are duplicates, a duplicate if one of them is canonical; its root is the least of those.
    ``stash`` writes a DataFrame and reads it again, once a round; each round settles an id at least.
    """
    state = stash(nodes.select("id", F.lit(None).cast("boolean").alias("canonical")), "greedy")
    edges = stash(edges.select("src", "dst").where("src < dst").distinct(), "greedy-edges")
    while True:
        seen = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"))
        seen = seen.agg(F.max(F.coalesce("canonical", F.lit(False))).alias("any_canonical"), F.min(F.coalesce(~F.col("canonical"), F.lit(False))).alias("all_duplicate"))
        joined = state.join(seen, "id", "left")
        settled = F.when(F.col("canonical").isNotNull(), F.col("canonical")).when(F.col("any_canonical").isNull() | F.col("all_duplicate"), F.lit(True)).when(F.col("any_canonical"), F.lit(False))
        state = stash(joined.select("id", settled.alias("canonical")), "greedy")
        if state.where("canonical is null").limit(1).count() == 0:
            break
    heads = state.where("canonical").select(F.col("id").alias("src"))
    roots = edges.join(heads, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("root"))
    return state.join(roots, "id", "left").select("id", F.when(F.col("canonical"), F.col("id")).otherwise(F.col("root")).alias("root"))
