"""Order-dependent operators: ids, carries, windows of characters, packing of paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import write_and_read


def _ranged(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows sorted over range partitions, written, with _part and _at (the place in it, from 0).

    Bounds of range partitions are sampled anew whenever a plan runs, so the partitions are written once
    and all that counts or numbers them reads the same rows.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return write_and_read(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", at), "ranged")


def global_id(df: DataFrame, order: list[str], name: str = "global_id") -> DataFrame:
    """1..N in order, with no task that holds all rows: counts of range partitions give their first ids.

    Ties in the order are numbered in any order; nulls come first. All columns stay.
    """
    parts = _ranged(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return parts.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def number_in_group(df: DataFrame, group: str | list[str], order: str | list[str], name: str, *, few: int = 0) -> DataFrame:
    """0..n-1 in each group, in order, however large it is: a group spreads over range partitions.

    Nulls form a group of their own. Ties in the order are numbered in any order. All columns stay. With ``few``
    runs at most (a group in a partition is one), the runs go to the rows, which don't move again.
    """
    group, order = ([x] if isinstance(x, str) else list(x) for x in (group, order))
    parts = _ranged(df, group + order)
    runs = parts.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a group is one run of a partition
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")  # a row for each partition that a group meets
    named = {g: f"_group{k}" for k, g in enumerate(group)}
    bases = runs.select(F.col("_part").alias("_p"), (earlier - F.col("_first")).alias("_base"), *[F.col(g).alias(n) for g, n in named.items()])
    if few and bases.limit(few + 1).count() <= few:
        bases = F.broadcast(bases)
    same = F.col("_part") == F.col("_p")
    for g, n in named.items():
        same &= F.col(g).eqNullSafe(F.col(n))
    return parts.join(bases, same).select(*df.columns, (F.col("_at") + F.col("_base")).cast("long").alias(name))


def carry_last(df: DataFrame, value: Column, within: list[str], order: str, name: str) -> DataFrame:
    """The last non-null value before each row."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(before))


def carry_previous(df: DataFrame, value: Column, within: list[str], order: str, name: str) -> DataFrame:
    """The value of the row before."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*within).orderBy(order)))


def running(df: DataFrame, value: Column, within: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def char_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """chunk_no (from 0), chunk_start, chunk: windows of ``size`` characters that share ``overlap``."""
    step = size - overlap
    n = F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - overlap) / step)).cast("int")
    out = df.withColumn("_count", count).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_count") - 1))).drop("_count")
    return out.withColumn("chunk_start", F.col("chunk_no") * step).withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)))


def pack(parts: list[str], most: int, overlap: int, joint: str = "\n\n") -> list[str]:
    """Paragraphs packed up to ``most`` characters.

    A new pack begins with as few of the last pack's paragraphs as reach ``overlap`` characters (each
    counted with a joint), and isn't measured again with them. A paragraph above ``most`` closes the pack
    and is cut into windows that share ``overlap``; nothing overlaps with it.
    """
    packs: list[str] = []
    own: list[str] = []
    step = most - overlap if most > overlap else most
    for part in parts:
        if len(part) > most:
            packs += [joint.join(own)] if own else []
            own = []
            packs += [part[at : at + most] for at in range(0, max(1, len(part) - (most - step)), step)]
            continue
        if own and len(joint.join([*own, part])) > most:
            packs.append(joint.join(own))
            reach = list(accumulate(len(x) + len(joint) for x in reversed(own)))
            enough = 1 + sum(n < overlap for n in reach)
            own = own[-enough:] if overlap > 0 else []
        own.append(part)
    return [*packs, joint.join(own)] if own else packs


def paragraph_packs(df: DataFrame, id_col: str, text: str, most: int, overlap: int, split: str = "\n\n", joint: str = "\n\n") -> DataFrame:
    """id, pack_no, pack of each document's non-blank paragraphs, in Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, n, p) for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, p in enumerate(pack([x.strip() for x in (t or "").split(split) if x.strip()], most, overlap, joint))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string()))], [id_col, "pack_no", "pack"])

    return df.select(F.col(id_col).cast("long"), text).mapInArrow(work, f"{id_col} long, pack_no int, pack string")
