"""Vector retrieval: distances, k nearest rows, neighbours above a threshold, context blocks.

All searches are one join: queries and corpus rows meet in cells. A cell that holds many rows is cut into
chunks of its corpus rows and blocks of its queries, and each pair of a chunk and a block is a unit that
one task compares by matrix products, keeping the k best rows for each of its queries. So no task, and
never the driver, holds all queries, all rows or a whole cell.

Rows whose vector is null, empty or holds null or non-finite components are neither found nor answered;
a zero vector has the similarity 0 to all. Vectors of one search have the same length. Ids are longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import write_and_read

#: Queries that are broadcast at most, how many times as many a block of a cell has, and corpus rows of a chunk, on average.
BLOCK_QUERIES, BLOCK_TIMES, CHUNK_ROWS = 4096, 4, 65_536
#: Similarities, and rows with their vectors, that a task holds at a time.
HELD_NUMBERS, HELD_ROWS = 1 << 20, 1 << 14
#: Pivots of an exact search above a threshold, at most, and rows that share one.
MOST_PIVOTS, PIVOT_ROWS = 256, 2048
#: The share of all cells from which on an exact search does without them.
MOST_VISITS = 0.5
#: Room for rounding when the triangle inequality leaves a cell out.
ROUNDING = 1e-6


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """Cosine distance (1 - cosine), or the squared L2 distance."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (norm(a) * norm(b))


def usable(vector: Column) -> Column:
    """Whether a vector can be compared."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of length 1 (or 0) from an Arrow column of vectors of the same length."""
    if not len(column):
        return np.zeros((0, 0))
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class _Best:
    """The k best rows of each query of a unit, updated a batch of rows at a time."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, least: float, digits: int):
        self.ids, self.units, self.k, self.least, self.digits = ids, units, k, least, digits
        self.near = np.full((len(ids), k), -np.inf)
        self.keys = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def add(self, keys: np.ndarray, units: np.ndarray) -> None:
        step = max(1, HELD_NUMBERS // max(1, len(keys)))
        for lo in range(0, len(self.ids), step):
            near = np.round(self.units[lo : lo + step] @ units.T, self.digits)
            kth = np.partition(near, -self.k, axis=1)[:, -self.k] if len(keys) > self.k else np.full(len(near), -np.inf)
            row, at = np.nonzero((near >= np.maximum(np.maximum(kth, self.near[lo : lo + step, -1]), self.least)[:, None]) & (near > -np.inf))
            hit = np.unique(row)
            old = np.repeat(hit, self.k)
            rows = np.concatenate([old, row])
            values = np.concatenate([self.near[lo + hit].ravel(), near[row, at]])
            names = np.concatenate([self.keys[lo + hit].ravel(), keys[at]])
            order = np.lexsort((names, -values, rows))
            first = np.searchsorted(rows[order], hit)
            taken = order[first[:, None] + np.arange(self.k)]
            self.near[lo + hit], self.keys[lo + hit] = values[taken], names[taken]

    def found(self) -> pa.RecordBatch:
        q, at = np.nonzero(self.near > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.keys[q, at]), pa.array(self.near[q, at])], ["query_id", "id", "similarity"])


def _compared(k: int, least: float, digits: int):
    """Over units sorted with their queries first (unit, is_row, id, vector): query_id, id, similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, best = None, None
        ids: list[np.ndarray] = []
        units: list[np.ndarray] = []
        for batch in batches:
            names, rows, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (rows[1:] != rows[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if names[lo] != unit:
                    if best is not None:
                        yield best.found()
                    unit, best, ids, units = names[lo], None, [], []
                own = matrix(batch.column(3).slice(lo, hi - lo))
                if not rows[lo]:
                    ids.append(keys[lo:hi])
                    units.append(own)
                elif ids or best is not None:
                    if best is None:
                        best = _Best(np.concatenate(ids), np.concatenate(units), k, least, digits)
                        ids, units = [], []
                    best.add(keys[lo:hi], own)
        if best is not None:
            yield best.found()

    return work


def _numbers(df: DataFrame) -> str:
    """The type that a table's vectors are moved in: floats stay floats (they are compared as doubles), all else is double."""
    return "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def cell_search(queries: DataFrame, corpus: DataFrame, k: int, *, least: float = -2.0, digits: int = 5) -> DataFrame:
    """query_id, id, similarity (cosine, rounded), rank: the k nearest rows in the cells of each query.

    queries: query_id, cell, embedding, a row for each cell to search; corpus: id, cell, embedding, each
    row in one cell. Rows under ``least`` aren't neighbours. Equal similarities go by id.
    """
    sized = lambda df, n, most: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(n))
    cells = write_and_read(sized(queries, "blocks", BLOCK_QUERIES * BLOCK_TIMES).join(sized(corpus, "chunks", CHUNK_ROWS), "cell"), "cells")  # a row for each cell
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(F.broadcast(cells), "cell").select("cell", part("query_id", "blocks").alias("block"), every("chunks").alias("chunk"), F.lit(0).alias("is_row"), F.col("query_id").alias("id"), "embedding")
    c = corpus.join(F.broadcast(cells), "cell").select("cell", every("blocks").alias("block"), part("id", "chunks").alias("chunk"), F.lit(1).alias("is_row"), "id", "embedding")
    kind = "array<float>" if {_numbers(queries), _numbers(corpus)} == {"array<float>"} else "array<double>"
    shown = lambda df: df.select(F.xxhash64("cell", "block", "chunk").alias("unit"), "is_row", F.col("id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("embedding"))
    units = shown(q).union(shown(c))
    met = units.repartition("unit").sortWithinPartitions("unit", "is_row").mapInArrow(_compared(k, least, digits), "query_id long, id long, similarity double")
    return _ranked(met, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")  # the plan keeps k rows of a query before they move
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, *, digits: int = 5) -> DataFrame:
    """query_id, id, similarity (cosine, rounded), rank of the k nearest rows of corpus (id, embedding).

    Queries (query_id, embedding) are compared with all rows; see ``neighbours`` and the collection's
    index for searches that leave most of them out. Up to ``BLOCK_QUERIES`` of them are broadcast, and the
    corpus stays where it is; more meet it in blocks and chunks, with the same result.
    """
    as_numbers = lambda df: df.where(usable(F.col("embedding"))).withColumn("embedding", F.col("embedding").cast(_numbers(df)))
    q, c = as_numbers(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")), as_numbers(corpus.select(F.col("id").cast("long").alias("id"), "embedding"))
    block = q.limit(BLOCK_QUERIES + 1).collect()
    if len(block) > BLOCK_QUERIES:
        return cell_search(q.withColumn("cell", F.lit(0)), c.withColumn("cell", F.lit(0)), k, digits=digits)
    shared = corpus.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in block], np.int64), matrix(pa.array([r.embedding for r in block], pa.list_(pa.float64())))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Best(*shared.value, k, -2.0, digits)
        for batch in batches:
            if batch.num_rows and len(own.ids):
                own.add(batch.column(0).to_numpy(), matrix(batch.column(1)))
        yield own.found()

    return _ranked(c.mapInArrow(best, "query_id long, id long, similarity double"), k)


def _cells_within(pivots: np.ndarray, radius: float, home_only: bool):
    """For rows (id, embedding): each with the cells that may hold a vector within ``radius`` of it.

    A row's home is its nearest pivot. The plane halfway between home and another pivot p lies
    (d(x, p)^2 - d(x, home)^2) / 2 d(home, p) away; whoever has p as home lies beyond it.
    """
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD_ROWS // (1 if home_only else len(pivots)))  # a row may visit every cell, with its vector
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            squares = 2 - 2 * matrix(batch.column(1)) @ pivots.T
            home = squares.argmin(axis=1)
            if home_only:
                row, cell = np.arange(batch.num_rows), home
            else:
                beyond = squares - squares[np.arange(len(home)), home][:, None]
                row, cell = np.nonzero(beyond <= 2 * radius * apart[home] + ROUNDING)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(cell.astype(np.int32)), taken.column(1)], ["id", "cell", "embedding"])

    return work


def _visits(pivots: np.ndarray, radius: float):
    """For rows (embedding): how many cells they visit in all."""
    within = _cells_within(pivots, radius, False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int64)), b.column(0)], ["id", "embedding"]) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in within(named))], pa.int64())], ["visits"])

    return work


def neighbours(rows: DataFrame, k: int, least: float, *, digits: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest of rows (id, embedding) to each of them, itself
    included, that reach the similarity ``least``; exact.

    Equal vectors are one class and carry their k smallest ids, as more of them never are among the k
    nearest. Each class goes home to the nearest of some pivots, and visits the cells that the triangle
    inequality doesn't rule out for ``least``; where vectors lie all about as far from one another (many
    dimensions, a low threshold), that is every cell, and the search compares all classes. Pivots are drawn by
    hash, at most ``MOST_PIVOTS``, one for ``PIVOT_ROWS`` classes. Visits are counted before any row moves: where
    they are most of all, cells save little and would move each row to each of them, so all classes share one.
    """
    kind = _numbers(rows)
    rows = rows.where(usable(F.col("embedding"))).select("id", F.col("embedding").cast(kind).alias("embedding"))
    keyed = write_and_read(rows.select("id", "embedding", F.xxhash64("embedding").alias("h")), "keyed")
    nth = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("id"))
    firsts = keyed.withColumn("nth", nth).where(F.col("nth") <= k)
    classes = write_and_read(firsts.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.element_at("ids", 1)), "classes")  # k ids at most
    wanted = 1 if least <= 0 else pivots or min(MOST_PIVOTS, -(-classes.count() // PIVOT_ROWS)) or 1  # a zero vector has the similarity 0 wherever it lies
    drawn = classes.select("embedding").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(wanted).collect()  # pivots alone
    at = matrix(pa.array([r.embedding for r in drawn], pa.list_(pa.float64()))) if drawn else np.zeros((1, 1))
    radius = float(np.sqrt(max(0.0, 2 - 2 * (least - 0.5 * 10.0**-digits))))
    schema = f"id long, cell int, embedding {kind}"
    vectors = classes.select("id", "embedding")
    if len(at) > 1:
        met = vectors.select("embedding").mapInArrow(_visits(at, radius), "visits long").agg(F.sum("visits")).first()[0] or 0
        at = at[:1] if met > MOST_VISITS * classes.count() * len(at) else at
    visits = vectors.mapInArrow(_cells_within(at, radius, False), schema).withColumnRenamed("id", "query_id")
    near = cell_search(visits, vectors.mapInArrow(_cells_within(at, radius, True), schema), k, least=least, digits=digits)
    found = near.join(classes.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("id"), "similarity")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id"))), 1, k)
    lists = write_and_read(found.groupBy("query_id").agg(best.alias("best")).join(classes.select(F.col("id").alias("query_id"), "h", F.col("embedding").alias("vector")), "query_id"), "lists")  # k * k at most
    met = keyed.join(lists, (keyed.h == lists.h) & (keyed.embedding == lists.vector)).select(keyed.id.alias("query_id"), F.posexplode("best").alias("pos", "hit"))
    return met.select("query_id", F.col("hit.id").alias("id"), (-F.col("hit.far")).alias("similarity"), (F.col("pos") + 1).cast("int").alias("rank"))


def context_block(hits: DataFrame, group: str, rank: str, *fields: str) -> DataFrame:
    """One text per group: "[Factoid i | a; b]" and the document, blank lines between, in rank order."""
    head = F.concat(F.lit("[Factoid "), F.col(rank).cast("string"), F.lit(" | "), F.concat_ws("; ", *fields), F.lit("]\n"), F.col("document"))
    parts = hits.select(group, F.struct(F.col(rank).alias("r"), head.alias("t")).alias("p")).groupBy(group).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return parts.select(group, F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n").alias("context"))
