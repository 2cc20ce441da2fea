"""Connected components over edge tables, in Spark alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_stash, stash


#: So many edges, at most, are joined in one task (32 bytes each); more take the rounds.
LOCAL_EDGES = 200_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[bytes, bytes] = {}

    def top(v: bytes) -> bytes:
        while (above := up.setdefault(v, v)) != v:
            up[v] = up.setdefault(above, above)
            v = above
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    names = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([top(v) for v in names], pa.binary())], ["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of edges (a, b), both binary; root is the component's smallest vertex.

    Up to ``LOCAL_EDGES`` edges are joined in one task, with the same result as by the rounds.
    Each round takes the least label among a vertex's own and its neighbours', and every second round
    the label of that label too. Labels are aggregated before they move, and adaptive execution splits
    the edges of a hub, so no vertex gathers its neighbours in one task. Rounds grow with the
    logarithm of a component's diameter.
    """
    edges = stash(edges.select("a", "b").where("a <> b"), "edges", narrow=True)
    if edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return stash(edges.repartition(1).mapInArrow(_local, "v binary, root binary"), "labels", narrow=True)
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stash(both.distinct(), "edges", narrow=True)
    labels = stash(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root")).select("v", F.least("v", "root").alias("root")), "labels", narrow=True)
    rounds = 0
    while True:
        rounds += 1
        own = labels.select("v", "root", F.col("root").alias("old"))
        told = both.join(labels, both.a == labels.v).select(F.col("b").alias("v"), "root", F.lit(None).cast("binary").alias("old"))
        after = own.union(told).groupBy("v").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        if rounds % 2 == 0:
            jump = labels.select(F.col("v").alias("root"), F.col("root").alias("next"))
            after = after.join(jump, "root").select("v", F.least("root", "next").alias("root"), "old")
        after = stash(after, "labels", narrow=True)
        changed = after.where("root <> old").limit(1).count()
        drop_stash(labels)
        labels = after.select("v", "root")
        if not changed:
            drop_stash(both)
            return labels
