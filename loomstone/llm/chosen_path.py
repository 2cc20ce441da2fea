"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct runs of ``words`` words (A-Z lower-cased, parted by white space); a
shorter text is one run, an empty one has no set. Sets that are equal are one class. For each class
128 minwise tokens are kept. Independent trees branch classes by tokens at chosen positions, so that
similar classes follow the same path. The first DEPTH branchings are taken at once; a node that
branches further takes one position, and sometimes a second (1/threshold on average). Nodes of up to
``LEAF`` classes are compared exhaustively on sketches of the tokens. In larger nodes every class is
compared with a few pivots. What is then outside the node's largest component of candidates is compared
with all of the node, in pairs of blocks, up to ``LOOSE`` classes; with more the node branches again,
and children all in one component end. After ``LEVELS`` all that is loose is compared in any case.

Classes whose sketches agree as often as similar sets nearly always do are candidates. Components of
candidates are compared exactly on the full sets of their whole texts: small ones each as one unit;
large ones in blocks that share pivots, after which every class outside a component's largest exact
part is compared with all of the component, in pairs of blocks. A chain of exact links makes a component.

Where nodes are small, a pair at the threshold misses all trees' leaves with probability 2e-7 at 85
percent and 4e-6 at 80 (drawn 6 million times with the trees' positions, three of which stand in two
trees), and its sketches' filter with 3e-5.

Edge cases: null, empty and blank texts have no set and are linked with nothing. Repeated rows are one
class and share the result. A null doc_id never is a component's id unless all of its rows have null.
``drop_near_duplicates`` keeps one row of a group, also where ids repeat or are null.
An empty table gives no rows. Further columns are kept by ``drop_near_duplicates`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import arrow_batches, held, stash

#: PERCENT is what op6 is to find; near-duplicates in general are STAGE_PERCENT alike or more.
WORDS, PERCENT, STAGE_PERCENT = 5, 85, 80
TOKENS, TREES, DEPTH, LEAF, LEVELS, PIVOTS = 128, 14, 2, 400, 6, 8
#: Classes of a large node that are compared with all of it, at most, before it branches again.
LOOSE = 2000
#: Classes of one exact comparison, and documents whose ids are broadcast to find their texts.
UNIT, BROADCAST_ROWS = 64, 500_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64((0xD1B54A32D192ED03 * (2 * k + 1) ^ (k * 0x8CB92BA72F3D8DD7)) & (2**64 - 1) | 1) for k in range(TOKENS)]


def agreements(percent: int) -> int:
    """Of TOKENS, how many agree for all but 3 in 100,000 pairs at the threshold."""
    j = percent / 100
    return max(1, int(TOKENS * j - 4 * (TOKENS * j * (1 - j)) ** 0.5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(ids) < words:
        words = len(ids)
    key = np.full(len(ids) - words + 1, words, np.uint64)
    for k in range(words):
        key = _mix(key * _MUL + ids[k : k + len(key)])
    return np.unique(key)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise tokens (32 bits) of each non-empty set."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    at = 0
    while at < len(sets):  # as much at once as stays in the cache
        upto, held = at, 0
        while upto < len(sets) and (held == 0 or held + len(sets[upto]) <= 1 << 15):
            held += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[at:upto])
        starts = np.cumsum([0] + [len(s) for s in sets[at : upto - 1]])
        for k, seed in enumerate(_SEEDS):
            out[at:upto, k] = np.minimum.reduceat((flat * seed) >> np.uint64(32), starts)
        at = upto
    return out


def features(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, v (128-bit digest of the set; null without one), tokens."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            some = [k for k, s in enumerate(sets) if len(s)]
            tokens = dict(zip(some, minwise([sets[k] for k in some]), strict=True)) if some else {}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([tokens[k].tobytes() if k in tokens else None for k in range(len(sets))], pa.binary()),
                ],
                ["doc_id", "th", "n_shingles", "v", "tokens"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(build, "doc_id long, th long, n_shingles long, v binary, tokens binary")


def _matrix(column: pa.Array, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _roots(classes: DataFrame) -> DataFrame:
    """node, v: the first DEPTH branchings of each tree, taken at once."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column(1)).astype(np.uint64)
            for tree in range(TREES):
                node = np.full(len(tokens), tree + 1, np.uint64)
                for level in range(DEPTH):
                    at = xxhash.xxh3_64_intdigest(b"%d %d" % (tree, level)) % TOKENS
                    node = _mix(_mix(node * _MUL + np.uint64(at)) + tokens[:, at])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0)], ["node", "v"])

    return classes.select("v", "tokens").mapInArrow(branch, "node long, v binary")


def _branch(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """node, v, label of the children: a node takes one position, and a second in so many cases that
    100/percent is the mean."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS - 1)), F.lit(TOKENS)).cast("int")
    twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < 1000 * (100 - percent) // percent
    at = F.explode(F.when(twice, F.array(first, second)).otherwise(F.array(first))).alias("at")
    met = rows.join(classes.select("v", "tokens"), "v").select("node", "v", "label", "tokens", at)
    return met.select(F.xxhash64("node", "at", F.substring("tokens", F.col("at") * 4 + 1, F.lit(4))).alias("node"), "v", "label")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one value of the first column after another; the rows are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
            part = batch.slice(lo, hi - lo)
            if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """The smallest member of each one's component."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def _alike(sketches: np.ndarray, others: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows that agree in ``least`` tokens."""
    rows, cols = [], []
    step = max(1, (1 << 22) // max(1, others.size))
    for at in range(0, len(sketches), step):
        r, c = np.nonzero((sketches[at : at + step, None, :] == others[None, :, :]).sum(axis=2, dtype=np.uint8 if TOKENS < 256 else np.uint16) >= least)
        rows.append(r + at)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _leaf_edges(rows: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """a, b: per leaf (node, v) a star over each component of candidates."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes]] = []
        for group in _groups(batches):
            names, sketch = group.column("v").to_pylist(), _matrix(group.column("sketch").combine_chunks(), np.uint8)
            order = sorted(range(len(names)), key=names.__getitem__)
            a, b = _alike(sketch[order], sketch[order], least)
            for x, r in enumerate(_forest(len(names), zip(a[a < b].tolist(), b[a < b].tolist(), strict=True))):
                if x != r:
                    found.append((names[order[r]], names[order[x]]))
            if len(found) > 10_000:
                yield _edge_batch(found)
                found = []
        yield _edge_batch(found)

    placed = rows.join(sketches, "v").select("node", "v", "sketch").repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(compare, "a binary, b binary")


def _edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], ["a", "b"])


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _only(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The classes that occur in rows; broadcasts their digests if there are few."""
    names = stash(rows.select("v").distinct(), "names", narrow=True)
    return classes.join(F.broadcast(names) if _few(names) else names, "v", "left_semi")


def _stars(rows: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """a, b: in each large node, an edge of every class (node, v) that is like a pivot to the most like,
    and of pivots like one another."""
    picks = rows.groupBy("node").agg(*[F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), "v")).alias(f"p{k}") for k in range(PIVOTS)])
    picks = picks.select("node", F.explode(F.array_distinct(F.array(*[f"p{k}.v" for k in range(PIVOTS)]))).alias("v"))
    pivots = picks.join(classes.select("v", "sketch"), "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("v", "sketch"))).alias("pivots"))  # PIVOTS of them at most
    joined = rows.join(classes.select("v", "sketch"), "v").join(pivots, "node").select("node", "v", "sketch", "pivots")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            sketch, names, found = _matrix(batch.column(2), np.uint8), batch.column(1).to_pylist(), []
            for own in np.unique(node):
                at = np.flatnonzero(node == own)
                pivots = batch.column(3)[int(at[0])].as_py()
                block = np.frombuffer(b"".join(p["sketch"] for p in pivots), np.uint8).reshape(len(pivots), -1)
                root = _forest(len(pivots), zip(*(x.tolist() for x in _alike(block, block, least)), strict=True))
                agree = (sketch[at][:, None, :] == block[None]).sum(axis=2)
                for r, k, n in zip(at.tolist(), agree.argmax(axis=1).tolist(), agree.max(axis=1).tolist(), strict=True):
                    if n >= least:
                        found.append((pivots[k]["v"], names[r]))
                found += [(pivots[r]["v"], pivots[k]["v"]) for k, r in enumerate(root) if k != r]
            yield _edge_batch(found)

    return joined.mapInArrow(work, "a binary, b binary").where("a <> b").distinct()


def _block_pairs(rows: DataFrame, loose: DataFrame, size: int) -> DataFrame:
    """unit and all columns of rows (node, n, …) and loose (node, m, …): units of a block of either.

    Of a node's n rows and m loose ones, every row meets every loose one in a unit of about 2 size.
    """
    blocks, chunks = (F.ceil(F.col(c) / size).cast("int") for c in ("n", "m"))
    mine = F.pmod(F.xxhash64("v"), blocks).cast("int"), F.pmod(F.xxhash64("v", F.lit(1)), chunks).cast("int")
    of = lambda df, i, j: df.withColumn("i", i).withColumn("j", j).withColumn("unit", F.xxhash64("node", "i", "j")).drop("i", "j")
    return of(rows, mine[0], F.explode(F.sequence(F.lit(0), chunks - 1))).union(of(loose, F.explode(F.sequence(F.lit(0), blocks - 1)), mine[1]))


def _nodes(rows: DataFrame) -> DataFrame:
    """node, n of nodes of two classes or more that don't all hang on one pivot; equal ones once."""
    labels = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("label").alias("labelled")] if "label" in rows.columns else []
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("v", F.lit(k))).alias(f"h{k}") for k in range(2)], *labels).where("n > 1")
    if labels:
        nodes = nodes.where("labelled < n or lo <> hi")
    return nodes.groupBy("n", "h0", "h1").agg(F.min("node").alias("node")).select("node", "n")


def candidates(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """v, root: components that hold every pair that the trees and sketches find."""
    least, rows, edges, level = agreements(percent), stash(_roots(classes), "nodes"), None, 0
    while True:
        level += 1
        nodes = stash(_nodes(rows), "kept-nodes", narrow=True)
        small = stash(rows.join(nodes.where(f"n <= {LEAF}").select("node"), "node").select("node", "v"), "leaves", narrow=True)
        found = stash(_leaf_edges(small, _only(classes, small).select("v", "sketch"), least), "candidates", narrow=True)
        edges = found if edges is None else edges.union(found)
        if nodes.where(f"n > {LEAF}").limit(1).count() == 0:
            return components(edges)
        large = stash(rows.join(nodes.where(f"n > {LEAF}"), "node").select("node", "v", "n"), "large", narrow=True)
        own = _only(classes, large)
        edges = edges.union(stash(_stars(large.select("node", "v"), own, least), "stars", narrow=True))
        found = components(edges)
        placed = stash(large.join(found, "v", "left").withColumn("root", F.coalesce("root", "v")), "placed", narrow=True)
        parts = placed.groupBy("node", "root", "n").count().groupBy("node", "n").agg(F.max(F.struct("count", "root")).alias("most"))
        parts = stash(parts.select("node", F.col("most.root").alias("main"), (F.col("n") - F.col("most.count")).alias("m")).where("m > 0"), "loose", narrow=True)
        if parts.limit(1).count() == 0:
            return found
        limit = 1 << 62 if level == LEVELS else LOOSE
        loose = placed.join(parts, "node").where(f"m <= {limit}").withColumn("is_loose", F.col("root") != F.col("main")).select("node", "v", "n", "m", "is_loose")
        loose = stash(loose, "loose-rows", narrow=True)
        if loose.limit(1).count():
            units = _block_pairs(loose, loose.where("is_loose"), LEAF // 2).select(F.col("unit").alias("node"), "v").distinct()
            edges = edges.union(stash(_leaf_edges(units, _only(classes, loose).select("v", "sketch"), least), "candidates", narrow=True))
        if level == LEVELS or parts.where(f"m > {LOOSE}").limit(1).count() == 0:
            return components(edges)
        rows = stash(_branch(placed.join(parts.where(f"m > {LOOSE}"), "node").select("node", "v", F.xxhash64("root").alias("label")), own, percent), "nodes")


def _similar(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= percent * union, by products of incidence matrices."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    if n < 2:
        return []
    both = np.zeros((n, n), np.int64)
    seen, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(seen), 1 << 14):
        lo, hi = np.searchsorted(column, (low, low + (1 << 14)))
        part = np.zeros((n, min(1 << 14, len(seen) - low)), np.float32)
        part[row[lo:hi], column[lo:hi] - low] = 1
        both += np.rint(part @ part.T).astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    return list(zip(a.tolist(), b.tolist(), strict=True))


def exact_links(units: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """a, b: per unit (unit, v, first_id, first_th) a star over each component of exact links."""
    wanted = units.groupBy("first_id", "first_th", "v").agg(F.collect_list("unit").alias("units"))
    wanted = stash(wanted, "wanted", narrow=True)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    if wanted.where("first_id is null").limit(1).count():  # texts without an id, each once
        texts = texts.where("doc_id is not null").union(texts.where("doc_id is null").dropDuplicates(["th"]))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    found = texts.join(F.broadcast(wanted) if _few(wanted) else wanted, same).select(F.explode("units").alias("unit"), "v", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[bytes, bytes]] = []
        for group in _groups(batches):
            sets = {}
            for name, text in zip(group.column("v").to_pylist(), group.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = shingles(text, words)
                if xxhash.xxh3_128_digest(own.tobytes()) == name:  # not another text of the same hash
                    sets[name] = own
            names = sorted(sets)
            for k, r in enumerate(_forest(len(names), _similar([sets[v] for v in names], percent))):
                if k != r:
                    edges.append((names[r], names[k]))
            if len(edges) > 10_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return found.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a binary, b binary")


def _units(sized: DataFrame, any_large: bool) -> DataFrame:
    """unit, v, first_id, first_th of the exact comparisons of members (root, n, v, first_id, first_th)."""
    small = sized.where(f"n <= {UNIT}").select(F.xxhash64("root", F.lit(0)).alias("unit"), "v", "first_id", "first_th")
    if not any_large:
        return small
    large = sized.where(f"n > {UNIT}")
    blocks = F.ceil(F.col("n") / (UNIT // 2)).cast("int")
    picks = large.groupBy("root", "n").agg(*[F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), "v", "first_id", "first_th")).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = picks.select("root", "n", F.explode(F.array_distinct(F.array(*[F.struct(f"p{k}.v", f"p{k}.first_id", f"p{k}.first_th") for k in range(PIVOTS)]))).alias("p"))
    pivots = pivots.select("root", F.explode(F.sequence(F.lit(1), blocks)).alias("block"), "p.v", "p.first_id", "p.first_th")
    own = large.select("root", (F.pmod(F.xxhash64("v"), blocks) + 1).cast("int").alias("block"), "v", "first_id", "first_th")
    blocked = own.union(pivots).select(F.xxhash64("root", "block").alias("unit"), "v", "first_id", "first_th")
    return small.union(blocked.distinct())


def _residual_units(large: DataFrame, linked: DataFrame) -> DataFrame:
    """unit, v, first_id, first_th of what is still to compare in large components (root, v, first_id, first_th).

    ``linked`` has the components of exact links. Each class outside the largest part of its component
    meets all of the component, in units of a block of either.
    """
    parts = stash(large.join(linked.select("v", F.col("root").alias("part")), "v", "left").withColumn("part", F.coalesce("part", "v")), "large", narrow=True)
    most = parts.groupBy("root", "part").count().groupBy("root").agg(F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("n"))
    most = most.select(F.col("root").alias("node"), "n", F.col("most.part").alias("main"), (F.col("n") - F.col("most.count")).alias("m")).where("m > 0")
    rows = parts.join(most, parts.root == most.node).select("node", "v", "first_id", "first_th", "n", "m", (F.col("part") != F.col("main")).alias("is_loose"))
    return _block_pairs(rows, rows.where("is_loose"), UNIT).select("unit", "v", "first_id", "first_th").distinct()


def _grouped(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, th, n_shingles, v, root (the group's least class; null without a set), component_id of each row."""
    arrow_batches(docs.sparkSession)
    rows = stash(features(docs, words), "features")
    classes = rows.where("v is not null").groupBy("v").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.min("tokens").alias("tokens"))
    classes = classes.select("v", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"), "tokens")
    classes = stash(_with_sketch(classes), "classes", narrow=True)
    found = candidates(classes, percent)
    sizes = found.groupBy("root").agg(F.count("*").alias("n"))
    members = stash(found.join(sizes, "root").join(_only(classes, found).select("v", "first_id", "first_th"), "v"), "members", narrow=True)
    large = members.where(f"n > {UNIT}").select("root", "v", "first_id", "first_th")
    any_large = large.limit(1).count() > 0
    links = stash(exact_links(_units(members, any_large), docs, percent, words), "links", narrow=True)
    linked = components(links)
    if any_large:
        more = stash(_residual_units(large, linked), "residual", narrow=True)
        if more.limit(1).count():
            linked = components(links.union(exact_links(more, docs, percent, words)))
    firsts = classes.select("v", "first_id").join(linked, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = firsts.where("root is not null").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = firsts.join(least, "root").select("v", "root", "component_id")
    out = rows.drop("tokens").join(named, "v", "left")
    return out.withColumn("component_id", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (by its id) of each row."""
    out = _grouped(docs, percent, words).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_sketch(classes: DataFrame) -> DataFrame:
    """Adds the low byte of each token."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = [np.frombuffer(t, np.uint32).astype(np.uint8).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch, pa.binary())], ["v", "first_id", "first_th", "tokens", "sketch"])

    return classes.mapInArrow(low, "v binary, first_id long, first_th long, tokens binary, sketch binary")


def drop_near_duplicates(docs: DataFrame, *, percent: int = STAGE_PERCENT, words: int = WORDS) -> DataFrame:
    """One row of each group, one with the smallest doc_id (null last); all columns as they were.

    Rows are told apart by doc_id and text, so that another text of the same id stays.
    """
    keys = _grouped(docs, percent, words).where("root is not null").groupBy("root", F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.count("*").alias("n"))
    keys = stash(keys, "keys", narrow=True)
    key = F.struct(F.col("gone_id").isNull().alias("none"), "gone_id", "gone_th")
    first = keys.groupBy("root").agg(F.min(key).alias("first"))
    met = stash(keys.join(first, "root").select("gone_id", "gone_th", "n", (key > F.col("first")).alias("gone")).where("gone or n > 1"), "marked", narrow=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # names can't clash there
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_th"))
    kept = rows.join(met, same, "left_anti")
    twice = met.where("not gone")
    if twice.limit(1).count():  # rows of one id and text: one of them
        again = rows.join(twice, same, "left_semi").select(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("th"), "row")
        kept = kept.union(again.dropDuplicates(["id", "th"]).select("row"))
    return kept.select("row.*")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=PERCENT)


OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * pairs.n >= {PERCENT} * (x.n + y.n - pairs.n)),
 ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reached(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, root FROM reached JOIN ways ON ways.a = reached.doc_id),
 least AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY 1)
SELECT least.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, least.doc_id = component_id AS kept FROM least LEFT JOIN n ON n.doc_id = least.doc_id
"""
