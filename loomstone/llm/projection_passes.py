"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class. A pass orders the classes lexicographically by ``BITS`` concatenated random
hyperplane hashes (the sides of random planes a vector lies on) and compares each with the ``window``
classes after it; another pass draws other planes. Two vectors at an angle t share their first k hashes
with a chance of (1 - t / pi) ** k, and among n classes about n / 2 ** k share k hashes, so a pass finds
a pair at the threshold with a chance of about p ** log2(n / window). Passes are repeated until all but
``miss`` of such pairs would be found: ``pass_count`` gives their number, which grows with the input.

Cosines are verified in double precision. A pass emits the links that join what its window hasn't
joined yet, no more than a forest; links of all passes are united to components. Within each
component all pairs are then compared, in pairs of blocks, and only the counts leave the tasks: so
n_links has every link of a component however wide its groups, and no list of pairs is ever made.

The order is dealt out by range partitioning, with a class's digest behind its hashes, so a clump of
equal hashes spreads over partitions too. Rows at the ends of partitions meet in a second step.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing.
Vectors of different lengths aren't compared. Repeated rows are vectors of their own, linked by their
equal vectors; a null vec_id never is the smallest unless all of a component are null. An empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import arrow_batches, stash, table

THRESHOLD, WINDOW, BITS, MISS, SEED = 0.9, 1024, 64, 0.005, 13
#: Passes that share one sort, and classes of a block when a component is compared.
TOGETHER, BLOCK = 3, 1024


def pass_count(n: int, *, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """How many passes miss a pair at the threshold with a chance of at most ``miss``, for n classes."""
    if n <= window:
        return 1
    found = (1 - acos(threshold) / pi) ** log2(n / (window / 2))
    return max(1, ceil(log(miss) / log(1 - found)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by their largest component, so that squares stay in range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, vectors = [], []
        for x in batch.column(1).to_pylist():
            a = np.array([] if x is None else [np.nan if y is None else y for y in x], np.float64)
            if a.size and np.isfinite(a).all() and a.any():
                data = (a + 0.0).tobytes()  # -0.0 is 0.0
                names.append(xxhash.xxh3_128_digest(data))
                vectors.append(data)
            else:
                names.append(None)
                vectors.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "v", "vector"])


def _keys(passes: range, bits: int, seed: int):
    """For rows (v, dim, vector): the rows once a pass, with pass and key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            keys = [[None] * len(raw) for _ in passes]
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                units = _unit(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), dim))
                for own, p in zip(keys, passes, strict=True):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, p, int(dim)]).standard_normal((dim, bits))
                    sides = np.packbits(units @ planes[p, dim] > 0, axis=1)
                    for i, side in zip(at, sides, strict=True):
                        own[i] = side.tobytes()
            for own, p in zip(keys, passes, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(raw), pa.int32()), batch.column(1), pa.array(own, pa.binary()), batch.column(0), batch.column(2)], ["pass", "dim", "key", "v", "vector"])

    return work


class _Forest:
    """Which classes the links so far have joined."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def top(self, v: bytes) -> bytes:
        while (above := self.up.setdefault(v, v)) != v:
            self.up[v] = v = self.up.setdefault(above, above)
        return v

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _near(ours: np.ndarray, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the pairs of unit rows that have the threshold's cosine or more."""
    return np.nonzero(ours @ others.T >= threshold)


def _links(rows: list[tuple], window: int, threshold: float, forest: _Forest, fresh: int) -> list[tuple[bytes, bytes]]:
    """A forest of the links of rows[fresh:] with the ``window`` rows before each; rows are (v, unit vector)."""
    units = np.array([r[1] for r in rows])
    edges = []
    for lo in range(fresh, len(rows), 256):
        hi, start = min(lo + 256, len(rows)), max(0, lo - window)
        i, j = _near(units[lo:hi], units[start:hi], threshold)
        ahead = (i + lo) - (j + start)
        for a, b in zip((i + lo)[(ahead > 0) & (ahead <= window)].tolist(), (j + start)[(ahead > 0) & (ahead <= window)].tolist(), strict=True):
            if forest.join(rows[a][0], rows[b][0]):
                edges.append((rows[a][0], rows[b][0]))
    return edges


_FOUND = "a binary, b binary, part int, tail boolean, pass int, dim int, n int, v binary, vector binary"


def _found(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    n = len(edges)
    cells = [pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)] + [pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays(cells, ["a", "b", "part", "tail", "pass", "dim", "n", "v", "vector"])


def _ends(part: int, tail: bool, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (pass, dim, v, vector) of an end of a partition, numbered in order."""
    n = len(rows)
    cells = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array([part] * n, pa.int32()), pa.array([tail] * n), *[pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)], pa.array(range(n), pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3)]]
    return pa.RecordBatch.from_arrays(cells, ["a", "b", "part", "tail", "pass", "dim", "n", "v", "vector"])


def _windows(window: int, threshold: float):
    """Over a sorted partition (part, pass, dim, v, vector): its links, and the rows at its two ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # the last of the run, (v, unit, raw)
        run, forest, part, count = None, _Forest(), None, 0
        head: list[tuple] = []
        last: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            cells = list(zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4)], strict=True))
            head += cells[: max(0, window - len(head))]
            last = (last + cells)[-window:]
            at = 0
            while at < len(cells):
                upto = next((k for k in range(at, len(cells)) if cells[k][:2] != cells[at][:2]), len(cells))
                if cells[at][:2] != run:
                    run, rows, forest = cells[at][:2], [], _Forest()
                units = _unit(np.frombuffer(b"".join(c[3] for c in cells[at:upto]), np.float64).reshape(upto - at, run[1]))
                fresh = len(rows)
                rows += [(c[2], u) for c, u in zip(cells[at:upto], units, strict=True)]
                yield _found(_links(rows, window, threshold, forest, fresh))
                rows = rows[-window:]
                count += upto - at
                if len(forest.up) > 16 * window:  # forget what has left the window: at worst a link is found twice
                    forest = _Forest()
                at = upto
        if part is not None:
            yield _ends(part, False, head)
            yield _ends(part, True, last)

    return work


def _seams(window: int, threshold: float):
    """Over rows sorted by seam and order: the links across the end of one partition and the start of the next."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seam, held = None, []

        def links() -> pa.RecordBatch:
            edges: list[tuple[bytes, bytes]] = []
            for kind in {r[1:3] for r in held if r[0]}:
                own = [r for r in held if r[1:3] == kind]
                fresh = sum(r[0] for r in own)
                units = _unit(np.frombuffer(b"".join(r[4] for r in own), np.float64).reshape(len(own), kind[1]))
                edges += _links([(r[3], u) for r, u in zip(own, units, strict=True)], window, threshold, _Forest(), fresh) if fresh < len(own) else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if row[0] != seam:
                    yield links()
                    seam, held = row[0], []
                held.append(row[1:])
        yield links()

    return work


def _pass_links(classes: DataFrame, passes: range, n: int, window: int, threshold: float, bits: int, seed: int) -> DataFrame:
    """a, b: links that the windows of some passes show."""
    spark = classes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(passes) * n // (8 * window)))
    keyed = classes.select("v", "dim", "vector").mapInArrow(_keys(passes, bits, seed), "pass int, dim int, key binary, v binary, vector binary")
    by = ["pass", "dim", "key", "v"]
    ordered = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "pass", "dim", "v", "vector")
    found = stash(ordered.mapInArrow(_windows(window, threshold), _FOUND), "windows")
    ends = found.where("v is not null")
    filled = ends.groupBy("part").agg(F.max("n").alias("n")).select(F.col("part").alias("own"), F.lead("part").over(_by_part()).alias("next"))  # a row a partition
    seams = ends.where("tail").select(F.col("part").alias("seam"), "tail", "pass", "dim", "v", "vector", "n")
    starts = ends.where("not tail").join(F.broadcast(filled.where("next is not null")), F.col("part") == F.col("next")).select(F.col("own").alias("seam"), "tail", "pass", "dim", "v", "vector", "n")
    met = seams.union(starts).repartition("seam").sortWithinPartitions("seam", F.col("tail").desc(), "n").select("seam", "tail", "pass", "dim", "v", "vector")
    across = met.mapInArrow(_seams(window, threshold), "a binary, b binary")
    return found.where("a is not null").select("a", "b").union(across)


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part")


def _counted(threshold: float):
    """Over units sorted by unit (unit, v, dim, n, left, right, vector): v, links of each class with those across."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def links() -> pa.RecordBatch:
            names, counts = [], []
            left, right = [r for r in held if r[3]], [r for r in held if r[4]]
            same = bool(left) and left[0][4]
            if left and right:
                units = lambda rows: _unit(np.frombuffer(b"".join(r[5] for r in rows), np.float64).reshape(len(rows), rows[0][1]))
                ours, others = units(left), units(right)
                i, j = _near(ours, others, threshold)
                if same:
                    i, j = i[i != j], j[i != j]
                weigh = lambda rows: np.array([r[2] for r in rows], np.int64)
                names += [r[0] for r in left]
                counts += np.bincount(i, weights=weigh(right)[j], minlength=len(left)).astype(np.int64).tolist()
                if not same:
                    names += [r[0] for r in right]
                    counts += np.bincount(j, weights=weigh(left)[i], minlength=len(right)).astype(np.int64).tolist()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64())], ["v", "links"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if row[0] != unit:
                    yield links()
                    unit, held = row[0], []
                held.append(row[1:])
        yield links()

    return work


def _link_counts(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """v, links: rows that classes of the same component link, by comparing all its blocks in pairs.

    members: v, root, blocks. A pair of a component's blocks is a unit.
    """
    placed = members.join(classes, "v")
    own = (F.pmod(F.xxhash64("v"), F.col("blocks"))).cast("int")
    placed = placed.select("root", "v", "dim", "n", "vector", "blocks", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    units = placed.select(F.xxhash64("root", low, high).alias("unit"), "v", "dim", "n", (F.col("own") == low).alias("left"), (F.col("own") == high).alias("right"), "vector")
    met = units.repartition("unit").sortWithinPartitions("unit").select("unit", "v", "dim", "n", "left", "right", "vector")
    return met.mapInArrow(_counted(threshold), "v binary, links long").groupBy("v").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None, bits: int = BITS, miss: float = MISS, seed: int = SEED
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors``."""
    arrow_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("x")).mapInArrow(_classes, "vec_id long, v binary, vector binary")
    rows = stash(rows, "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = stash(classes.select("v", "n", "least", (F.length("vector") / 8).cast("int").alias("dim"), "vector"), "classes")
    n = classes.count()
    total = passes or pass_count(n, threshold=threshold, window=window, miss=miss)
    edges = None
    for first in range(0, total, TOGETHER):
        found = stash(_pass_links(classes, range(first, min(first + TOGETHER, total)), n, window, threshold, bits, seed), "links", narrow=True)
        edges = found if edges is None else edges.union(found)
    linked = stash(components(edges.distinct()).select("v", "root").join(classes.select("v", "least"), "v"), "components", narrow=True)
    roots = stash(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "roots", narrow=True)
    linked = stash(linked.join(roots, "root").select("v", "root", "component_id", "blocks"), "members", narrow=True)
    counts = _link_counts(linked, classes.select("v", "dim", "n", "vector"), threshold)
    named = linked.join(counts, "v", "left").select("v", "component_id", "links")
    done = classes.select("v", "n", "least").join(named, "v", "left")
    done = stash(done.select("v", F.coalesce("component_id", "least").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counts", narrow=True)
    out = rows.where("v is not null").select("vec_id", "v").join(done, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH RECURSIVE c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 ok AS (SELECT vec_id, x FROM c WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_max(list_transform(x, lambda y: abs(y))) > 0),
 u AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS x FROM ok),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) >= {THRESHOLD}),
 reached(v, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, root FROM reached JOIN links ON links.a = reached.v),
 least AS (SELECT v, min(root) AS component_id FROM reached GROUP BY 1), degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v = component_id AS kept FROM least LEFT JOIN degree ON a = v
"""
