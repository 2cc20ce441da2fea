"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed 1- to 3-grams of its lower-cased letters (all else is one blank),
with logarithmic term weights and length 1. Each language has several centroids, found by spherical
k-means over a bounded sample of labelled documents, whose vectors (not texts) come to the driver;
inverse document frequencies are counted over all of them. The language of the centroid with the
largest cosine is the prediction.

A text is rejected if it has no letter or lies further from every centroid than labelled texts of its
length do. One sampled document in ``CHECK_EACH`` is kept from the centroids; its text is cut to 1, 2,
4, … letters, and ``SLACK`` times the cosine that all but ``REJECT_RATE`` of the cuts of every language reach
is the least one for texts from that length to the next. So fewer than ``REJECT_RATE`` of texts like the
labelled ones are rejected at any length. Lengths with under ``LEAST_CUTS`` cuts take the next shorter one's.

Edge cases: null, empty and letterless texts get ``und``, score 0, and are rejected. Equal scores go
to the language first in code point order. Repeated rows are judged row by row. Without any labelled
text every prediction is ``und``. Further columns are kept by ``drop_rejected`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow_batches

DIMS = 4096
#: Labelled documents per language, and of all languages, that the model is fitted on, at most.
FIT_ROWS, FIT_ALL = 800, 16_000
#: Values of lang, at most; with more the fit fails, as none is left out.
MOST_LANGUAGES = FIT_ALL // 8
CLUSTERS, CHECK_EACH, REJECT_RATE, SLACK, LEAST_CUTS, LENGTHS = 4, 4, 0.005, 0.8, 20, 24
CHUNK_CHARS, CHUNK_TEXTS = 1 << 20, 64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Each code point's own number if it is a letter, else 32."""
    if not _letters:
        _letters.append(np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32))
    return _letters[0]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x DIMS) and numbers of letters of a few texts."""
    lowered = [t.lower() for t in texts]
    codes = _letter_table()[np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = codes != 32
    total = np.bincount(owner[letter], minlength=len(texts))
    mixed = codes * np.uint32(0x9E3779B1)
    two = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + mixed[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + mixed[2:]
    out = np.zeros(len(texts) * DIMS, np.int64)
    for keys, used in ((mixed, letter), (two, letter[:-1] | letter[1:]), (three, letter[1:-1])):
        at = owner[: len(keys)][used] * DIMS + ((keys[used] >> np.uint32(7)) ^ (keys[used] >> np.uint32(19))) % DIMS
        out += np.bincount(at, minlength=len(out))
    return out.reshape(len(texts), DIMS), total


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places, counts and letters of the non-empty texts, a bounded number at a time."""
    held, chars = [], 0
    for place, text in enumerate(texts):
        if text:
            held.append(place)
            chars += len(text)
        if held and (chars >= CHUNK_CHARS or len(held) == CHUNK_TEXTS or place == len(texts) - 1):
            yield held, *_counts([texts[k] for k in held])
            held, chars = [], 0


@dataclass
class CentroidModel:
    languages: list[str]
    centroids: np.ndarray  # rows x DIMS, length 1
    owner: np.ndarray  # language of each row
    idf: np.ndarray
    reach: np.ndarray  # by bit_length(letters): the least cosine that isn't rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether each text is rejected."""
        found, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return found, scores, rejected
        for places, counts, letters in _chunks(texts):
            cosines = self.vectors(counts) @ self.centroids.T
            best = np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            for row, (place, n) in enumerate(zip(places, letters.tolist(), strict=True)):
                if n:
                    k = int(best[row].argmax())
                    found[place], scores[place] = self.languages[k], min(1.0, max(0.0, float(best[row, k])))
                    rejected[place] = scores[place] < self.reach[min(int(n).bit_length(), len(self.reach) - 1)]
        return found, scores, rejected


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids of length 1; starts from rows far from one another."""
    mean = rows.mean(axis=0)
    centres = [rows[int((rows @ mean).argmax())]]
    while len(centres) < min(k, len(rows)):
        nearest = (rows @ np.array(centres).T).max(axis=1)
        centres.append(rows[int(nearest.argmin())])
    out = np.array(centres)
    for _ in range(rounds):
        mine = (rows @ out.T).argmax(axis=1)
        out = np.array([rows[mine == c].mean(axis=0) for c in range(len(out)) if (mine == c).any()])
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def fit(docs: DataFrame, *, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS) -> CentroidModel:
    """Learn from the text and lang of ``docs``; rows without either are left out."""
    arrow_batches(docs.sparkSession)
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, counts, _ in _chunks(batch.column(0).to_pylist()):
                total += (counts > 0).sum(axis=0)
                seen += len(counts)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[seen], total]))], ["term", "n"])

    counted = {r.term: r.n for r in labelled.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = counted.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([counted.get(k, 0) for k in range(DIMS)]))).astype(np.float32) + 1
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: each is learned, so a column of other values isn't one of languages")
    model = CentroidModel([], np.zeros((0, DIMS), np.float32), np.zeros(0, int), idf, np.zeros(LENGTHS))
    if not n or not sizes:
        return model
    fit_rows = min(fit_rows, FIT_ALL // len(sizes))
    ticks = 1 << 60
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, int(min(1.0, 1.2 * fit_rows / size) * ticks))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ticks))
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), "text").dropDuplicates(["lang", "draw"])
    fitted: dict[str, list] = {lang: [] for lang in sorted(sizes)}
    checked: dict[str, list] = {lang: [] for lang in fitted}
    for r in sample.mapInArrow(_sparse, SPARSE).orderBy("draw", "lang", "letters").toLocalIterator():
        kept, most = (checked, fit_rows * LENGTHS) if r.draw % CHECK_EACH == 0 else (fitted, fit_rows)
        if len(kept[r.lang]) < most:
            kept[r.lang].append((r.letters, r.at, r.n))
    rows, owner = [], []
    for lang, own in fitted.items():
        if own:
            rows.append(spherical_kmeans(model.vectors(_dense(own)), clusters))
            owner += [len(model.languages)] * len(rows[-1])
            model.languages.append(lang)
    if rows:
        model.centroids, model.owner = np.concatenate(rows).astype(np.float32), np.array(owner)
        model.reach = _reach(model, [own for own in checked.values() if own])
    return model


SPARSE = "lang string, draw long, letters long, at binary, n binary"


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, draw, text): the vector of each text, or of its cuts where it is kept for checks."""
    for batch in batches:
        out = []
        for lang, draw, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for _, counts, letters in _chunks(_cuts(text) if draw % CHECK_EACH == 0 else [text]):
                for row, n in zip(counts, letters.tolist(), strict=True):
                    at = np.flatnonzero(row)
                    if n:
                        out.append({"lang": lang, "draw": draw, "letters": n, "at": at.astype(np.uint16).tobytes(), "n": row[at].astype(np.uint32).tobytes()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("draw", pa.int64()), ("letters", pa.int64()), ("at", pa.binary()), ("n", pa.binary())]))


def _cuts(text: str) -> list[str]:
    """From the middle of a text, as much as holds 1, 2, 4, … letters."""
    before = np.cumsum([c.isalpha() for c in text])
    total = int(before[-1]) if len(before) else 0
    out = []
    for k in range(total.bit_length()):
        skipped = (total - (1 << k)) // 2
        lo, hi = np.searchsorted(before, (skipped + 1, skipped + (1 << k)))
        out.append(text[lo : hi + 1])
    return out


def _dense(rows: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.int64)
    for k, (_, at, n) in enumerate(rows):
        out[k, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    return out


def _reach(model: CentroidModel, checked: list[list[tuple[int, bytes, bytes]]]) -> np.ndarray:
    """For each length, SLACK times the least of what all but REJECT_RATE of a language's cuts reach."""
    least = np.full(LENGTHS, np.inf)
    for own in checked:
        for lo in range(0, len(own), 256):
            part = own[lo : lo + 256]
            own[lo : lo + 256] = [(n, float(c), None) for (n, *_), c in zip(part, (model.vectors(_dense(part)) @ model.centroids.T).max(axis=1), strict=True)]
        lengths, cosines = np.array([int(n).bit_length() for n, *_ in own]), np.array([c for _, c, _ in own])
        for k in range(LENGTHS):
            if (lengths == k).sum() >= LEAST_CUTS:
                least[k] = min(least[k], SLACK * np.quantile(cosines[lengths == k], REJECT_RATE, method="lower"))
    for k in range(LENGTHS):
        if not np.isfinite(least[k]):
            least[k] = least[k - 1] if k else 0.0
    return least


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """The rows that aren't rejected, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~shared.value.predict(batch.column(at).to_pylist())[2]))

    return docs.mapInArrow(keep, docs.schema)


def op8_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
