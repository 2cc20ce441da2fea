"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of kinds of bytes, word and line lengths, repetition) are computed in
Arrow batches and written once. Labelled rows, a bounded sample of them, are binned at quantiles; trees
of fixed depth are grown level by level on histograms of gradients, and flattened into arrays of one
feature, threshold and value per node, in the order of a complete binary tree. A batch is scored by
stepping all rows through one level of all trees at a time.

Edge cases: a null text is empty; empty texts have statistics of 0 and get a score as all others.
Labels that are null are left out; a document with several labels counts with each. Repeated rows are
scored alike. Without labels, or with one kind alone, the score is that kind's share (0.5 without any).
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow_batches, stash

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_ROWS = 64, 80, 4, 0.1, 1.0, 20
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".", "comma": b",",
    "loud": b"!?", "bar": b"|", "symbol": b"#$%&*^~`", "tag": b"<>{}[]\\", "paren": b"()", "quote": b"\"'", "joint": b"-_/:;=+@", "wide": bytes(range(128, 256)), "control": bytes([*range(9), *range(11, 32), 127]),
}
NAMES = [*_KINDS, "chars", "words", "word_chars", "word_long", "word_short", "word_distinct", "word_top", "pair_distinct", "word_repeat", "upper_words", "marked_words", "lines", "line_chars", "line_distinct", "line_top", "line_ended", "stop_spacing"]


def _kind_table() -> np.ndarray:
    table = np.zeros((256, len(_KINDS)))
    for k, own in enumerate(_KINDS.values()):
        table[list(own), k] = 1
    return table


_TABLE = _kind_table()


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of NAMES for each UTF-8 text."""
    texts = [t or b"" for t in texts]
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), len(NAMES)))
    lo = 0
    while lo < len(texts):  # some megabytes at a time
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), 4 << 20)))
        codes = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        owner = np.repeat(np.arange(hi - lo, dtype=np.int64), size[lo:hi])
        counts = np.bincount((owner << 8) + codes, minlength=(hi - lo) << 8)[: (hi - lo) << 8].reshape(-1, 256)
        out[lo:hi, : len(_KINDS)] = (counts @ _TABLE) / np.maximum(size[lo:hi, None], 1)
        lo = hi
    for k, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        pairs = len(set(zip(words, words[1:])))  # noqa: B905
        lines = t.split(b"\n")
        kinds: dict[bytes, int] = {}
        for x in lines:
            kinds[x] = kinds.get(x, 0) + 1
        out[k, len(_KINDS) :] = (
            np.log1p(len(t)), np.log1p(n), lengths.mean(), (lengths > 15).mean(), (lengths < 3).mean(), len(seen) / n, max(seen.values()) / n, pairs / max(1, n - 1), sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
            sum(map(bytes.isupper, words)) / n, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, np.log1p(len(lines)), np.log1p(len(t) / len(lines)), len(kinds) / len(lines), max(kinds.values()) / len(lines),
            sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), n / (1 + t.count(b".")) / n,
        )
    return out


@dataclass
class BoostedTrees:
    """Trees as arrays: node k has children 2k+1 and 2k+2; leaves follow the inner nodes."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # a row goes right if its feature is above
    value: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(rows):
            return np.full(len(rows), 1 / (1 + np.exp(-self.base)))
        inner, trees = self.feature.shape[1], np.arange(len(self.feature))
        at, place = np.zeros((len(rows), len(trees)), np.int64), np.arange(len(rows))[:, None]
        while at[0, 0] < inner:
            at = 2 * at + 1 + (rows[place, self.feature[trees, at]] > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at - inner].sum(axis=1))))


def grow(rows: np.ndarray, labels: np.ndarray, *, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
    """Boosting with the logistic loss."""
    inner, leaves, width = (1 << depth) - 1, 1 << depth, rows.shape[1] if rows.ndim == 2 else 0
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return BoostedTrees(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS)[1:-1], method="lower")) for k in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, k], "left") for k, e in enumerate(edges)], axis=1)
    base, raw = float(np.log(share / (1 - share))), np.full(len(rows), np.log(share / (1 - share)))
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess, at = labels - p, p * (1 - p), np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            slot = (at - first)[:, None] * (width * BINS) + np.arange(width) * BINS + binned
            g, h, n = (np.bincount(slot.ravel(), None if w is None else np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for w in (grad, hess, None))
            gain = lambda g, h: g * g / (h + RIDGE)
            gr, hr, nr = g[..., -1:] - g, h[..., -1:] - h, n[..., -1:] - n
            won = np.where((n >= LEAST_ROWS) & (nr >= LEAST_ROWS), gain(g, h) + gain(gr, hr) - gain(g[..., -1:], h[..., -1:]), -1.0).reshape(nodes, -1)
            best = won.argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS)
                if won[k, best[k]] > 1e-9 and b < len(edges[f]):
                    feature[tree, first + k], threshold[tree, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), feature[tree, at]] > threshold[tree, at])
        leaf = at - inner
        g, h = (np.bincount(leaf, w, leaves) for w in (grad, hess))
        value[tree] = RATE * g / (h + RIDGE)
        raw += value[tree][leaf]
    return BoostedTrees(base, feature, threshold, value)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row (NAMES as doubles) of each row."""
    arrow_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column(1).cast(pa.binary()).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(NAMES)), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), flat], ["doc_id", "row"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, row array<double>")


def fit(measured: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> BoostedTrees:
    """Learn ``quality`` of labels (doc_id, quality) from rows (doc_id, row)."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    # drawn by a hash first, so that not much more than fit_rows reach the driver from all partitions
    ticks, draw = 1 << 40, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, 1.2 * fit_rows / max(1, known.count()))
    drawn = measured.join(known.where(draw < int(share * ticks)), "doc_id")
    found = drawn.orderBy(draw, "doc_id", "quality").limit(fit_rows).select("row", "quality").toPandas()
    return grow(np.array(found["row"].tolist(), float).reshape(-1, len(NAMES)), (found["quality"].to_numpy(float) > 0).astype(float))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def score(measured: DataFrame, model: BoostedTrees) -> DataFrame:
    """doc_id, score of each row (doc_id, row)."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(rows))], ["doc_id", "score"])

    return measured.select("doc_id", "row").mapInArrow(scored, "doc_id long, score double")


def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    measured = stash(document_statistics(docs), "statistics")
    found = score(measured, fit(measured, labels.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
