"""Benchmark decontamination by greedy string tiling.

A document that shares a run of ``least`` words with a benchmark item is compared with that item: the
longest common runs that don't overlap are marked as tiles, longest first (the one first in the item,
then in the text, where some are equally long), found by running Karp-Rabin matching, until none of
``least`` words is left. The share of an item's words under tiles is its coverage, which stays high
where a passage's parts come in another order. An item of fewer than ``least`` words is a tile as a whole
or not at all.

The benchmark comes in blocks of at most ``BLOCK_WORDS`` words, and only one block is broadcast at a
time: a larger benchmark takes more passes over the documents, each written before the next begins,
with the same result. Words are what stands between white space and ASCII punctuation, lower-cased.

Edge cases: null and empty texts match nothing; items without words (null and empty ones too) can't be
matched. Rows of a table that repeat are judged row by row. Empty tables give no matches. Further
columns are kept by ``drop_contaminated`` and not read by ``tile_matches``.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import arrow_batches, held, stash

LEAST_WORDS, LEAST_COVERAGE = 5, 0.6
#: Words of one broadcast block of the benchmark.
BLOCK_WORDS = 1_000_000
#: Common runs that are looked at before those are left out that can't be tiles any more.
_STEP = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_SPLIT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
MATCHES = "doc_id long, item_id long, tiles int, covered_words int, item_words int, coverage double, spans array<struct<item_at:int,doc_at:int,words:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(item_at, text_at, words) of the tiles. Negative entries match nothing.

    Whatever runs of free words are left at any time lie within the common runs found at first. So these
    wait in order of length; one that earlier tiles have cut comes back as its free parts. It ends when
    the item has fewer than ``least`` free words.
    """
    item, text = np.asarray(item, np.int64), np.asarray(text, np.int64)
    item, text = np.where(item < 0, -1, item), np.where(text < 0, -2, text)
    free_i, free_t = item >= 0, text >= 0
    runs = _common_runs(item, text, least)
    tiles, parts, at, left = [], [], 0, int(free_i.sum())
    ahead = runs[:_STEP].tolist()
    while left >= least and (at < len(ahead) or len(runs) > _STEP or parts):
        if at == len(ahead) and len(runs) > _STEP:  # those without so many free words of the item can't be tiles any more
            whole = np.concatenate([[0], np.cumsum(free_i)])
            runs = runs[_STEP:]
            runs = runs[whole[runs[:, 1] - runs[:, 0]] - whole[runs[:, 1]] >= least]
            ahead, at = runs[:_STEP].tolist(), 0
            continue
        if not parts or at < len(ahead) and ahead[at] <= parts[0]:
            size, i, t = ahead[at]
            at += 1
        else:
            size, i, t = heapq.heappop(parts)
        free = free_i[i : i - size] & free_t[t : t - size]
        if free.all():
            if not np.array_equal(item[i : i - size], text[t : t - size]):
                continue  # equal hashes of other words
            free_i[i : i - size] = free_t[t : t - size] = False
            left += size
            tiles.append((i, t, -size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= least:
                heapq.heappush(parts, [lo - hi, i + lo, t + lo])
    return tiles


def _common_runs(item: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Maximal common runs of ``least`` words or more: (-words, item_at, text_at), in order.

    They begin where a window of ``least`` words has the same hash in both and the words before differ;
    their ends are found by hashes of windows whose lengths double.
    """
    windows = [_window_hashes(x, least, min(len(item), len(text))) for x in (item, text)]
    own, other = (w[0][1] for w in windows)
    if not len(own) or not len(other):
        return np.zeros((0, 3), np.int64)
    before = np.concatenate([[-3], text[:-1]])[: len(other)]
    order = np.lexsort((before, other))
    keys, words = other[order], before[order]
    lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
    starts_i, starts_t = [], []
    for i in np.flatnonzero(hi > lo).tolist():
        a, b, word = int(lo[i]), int(hi[i]), int(item[i - 1]) if i else -4
        x, y = a + np.searchsorted(words[a:b], (word, word + 1)) if word >= 0 else (a, a)  # parts of runs that start earlier
        for places in (order[a:x], order[y:b]):
            starts_i.append(np.full(len(places), i))
            starts_t.append(places)
    i, t = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (starts_i, starts_t))
    n = np.zeros(len(i), np.int64)
    for (size, own), (_, other) in zip(*(w[::-1] for w in windows), strict=True):
        for _ in range(2 if size == windows[0][-1][0] else 1):
            can = np.flatnonzero((i + n < len(own)) & (t + n < len(other)))
            can = can[own[i[can] + n[can]] == other[t[can] + n[can]]]
            n[can] += size
    while len(go := np.flatnonzero((i + n < len(item)) & (t + n < len(text)))):
        go = go[item[i[go] + n[go]] == text[t[go] + n[go]]]
        if not len(go):
            break
        n[go] += 1
    keep = n >= least
    i, t, n = i[keep], t[keep], n[keep]
    first = np.lexsort((t, i, -n))
    return np.stack([-n[first], i[first], t[first]], axis=1)


def _window_hashes(words: np.ndarray, least: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(size, a hash of each window of so many words) for ``least``, twice that and so on up to ``most``."""
    mix = lambda x: (x ^ (x >> np.uint64(29))) * _BASE + np.uint64(1)
    size, key = least, np.zeros(max(0, len(words) - least + 1), np.uint64)
    for k in range(least):
        key = mix(key + words[k : k + len(key)].astype(np.uint64))
    out = [(size, key)]
    while 2 * size <= most:
        key = mix(key[: len(key) - size] * _SECOND + mix(key[size:] ^ _BASE))
        size *= 2
        out.append((size, key))
    return out


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n ids; windows over an id 0 give 0."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    key, whole = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(n):
        part = ids[k : k + m]
        key = key * _BASE + part.astype(np.uint64)
        whole &= part != 0
    key ^= key >> np.uint64(29)
    return np.where(whole, key | np.uint64(1), np.uint64(0))


class BenchmarkIndex:
    """One block of items: word numbers and the sorted hashes of their runs of ``least`` words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], least: int):
        self.least, self.number = least, {}
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)) for i, words in items]
        self.sizes = sorted({min(least, len(words)) for _, words in self.items})
        self.tables = {}  # items of fewer than ``least`` words are found by runs of all their words
        for n in self.sizes:
            places = [k for k, (_, words) in enumerate(self.items) if min(least, len(words)) == n]
            keys = [_grams(self.items[k][1], n) for k in places]
            flat, owner = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.repeat(places, [len(k) for k in keys])
            order = np.argsort(flat, kind="stable")
            self.tables[n] = flat[order], owner[order]

    def tiles(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, list]]:
        """(text's place, item's place, words of the item, tiles) of each pair that shares a run."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in words])  # a 0 parts the texts
        ids = np.zeros(int(sizes.sum()), np.int64)
        starts = np.cumsum(sizes) - sizes
        get = self.number.get
        for s, w in zip(starts.tolist(), words, strict=True):
            ids[s : s + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        for n, (known, owner) in self.tables.items():
            keys = _grams(ids, n)
            at = np.flatnonzero(keys)
            lo, hi = (np.searchsorted(known, keys[at], side) for side in ("left", "right"))
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            pairs: dict[tuple[int, int], list[int]] = {}
            for a, d, x, y in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), lo.tolist(), hi.tolist(), strict=True):
                for item in set(owner[x:y].tolist()):
                    pairs.setdefault((d, item), []).append(a)
            for (d, item), seeds in pairs.items():
                pattern = self.items[item][1]
                covered = np.unique(np.add.outer(seeds, np.arange(n)))  # nothing else can be under a tile
                gaps = np.flatnonzero(np.diff(covered) > 1) + 1
                text = np.insert(ids[covered], gaps, -1).tolist()
                place = np.insert(covered - starts[d], gaps, -1).tolist()
                yield d, item, len(pattern), [(i, place[t], k) for i, t, k in greedy_tiles(pattern.tolist(), text, n)]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row.text)
        if not words:
            continue
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row.item_id, words))
        held += len(words)
    if block:
        yield block


def _index(name: str, shared, least: int) -> BenchmarkIndex:
    """The index of a broadcast block, built once in each worker."""
    return held("benchmark", name, build=lambda: BenchmarkIndex(shared.value, least))


def tile_matches(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST_WORDS, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """A row per document and item whose coverage reaches ``coverage``, with its tiles."""
    spark = docs.sparkSession
    arrow_batches(spark)
    out = last = None
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("covered_words", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64()), ("spans", pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])))])
    for block in _blocks(benchmark):
        if last is not None:  # the pass before is written, and its block let go
            out = stash(out, "matches")
            last.destroy()
        last = shared = spark.sparkContext.broadcast(block)
        name = uuid.uuid4().hex

        def match(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, least)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for d, item, size, tiles in index.tiles(batch.column(1).to_pylist()):
                    covered = sum(n for _, _, n in tiles)
                    if covered >= coverage * size:
                        spans = [{"item_at": i, "doc_at": t, "words": n} for i, t, n in sorted(tiles)]
                        rows.append({"doc_id": ids[d], "item_id": index.items[item][0], "tiles": len(tiles), "covered_words": covered, "item_words": size, "coverage": covered / size, "spans": spans})
                yield pa.RecordBatch.from_pylist(rows, kinds)

        found = docs.select("doc_id", "text").mapInArrow(match, MATCHES)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCHES) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST_WORDS, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """The documents no item of which is covered to ``coverage``; no row is moved between tasks."""
    spark = docs.sparkSession
    arrow_batches(spark)
    at, last = docs.columns.index("text"), None
    for block in _blocks(benchmark):
        if last is not None:
            docs = stash(docs, "clean")
            last.destroy()
        last = shared = spark.sparkContext.broadcast(block)
        name = uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, least)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for d, _, size, tiles in index.tiles(batch.column(at).to_pylist()):
                    if sum(n for _, _, n in tiles) >= coverage * size:
                        clean[d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return tile_matches(docs, benchmark).drop("spans")
