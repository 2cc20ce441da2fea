"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each further
frame is one whole WARC/1.1 record, so records can be reached and decoded one by one. The writer
plans response and revisit records with DataFrame operations and writes an archive per task; the
reader decodes a frame at a time in bounded memory and checks version line, mandatory headers,
lengths, the trailing blank lines and both digests.

Edge cases: a null payload is an empty one. Payloads under ``min_revisit_bytes`` are always responses.
Rows that repeat the smallest id of equal payloads are responses as well; rows with a null id come
after all others (revisits if any row with an id has that payload, else responses). A null url is
written as ``urn:page:<id>`` and read as null; control characters in urls are percent-encoded. An
empty table gives no archives and no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow_batches, new_folder, opened, qualified, replacing, stash

DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
READ_BYTES = 1 << 18
#: Payloads that the dictionary is trained on, and its size.
DICT_SAMPLE_ROWS, DICT_BYTES = 400, 64 << 10
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "file string, records long"
READ = "file string, record_offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; few or tiny samples give their own bytes as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    if data[:4] == ZSTD_MAGIC:
        data = zstandard.ZstdDecompressor().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def make_record(page_id, url, payload: bytes, refers_to, date: str, is_revisit: bool) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if is_revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises WarcError where the record breaks the format."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not split or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [k for k in MANDATORY if k not in headers]
    if missing:
        raise WarcError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {headers['content-length']}, the frame has {len(rest) - 4} bytes of block")
    block = rest[:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block differs from WARC-Block-Digest")
    kind, url = headers["warc-type"], headers.get("warc-target-uri")
    if kind not in ("response", "revisit") or not headers.get("content-type", "application/http").startswith("application/http"):
        # other records (warcinfo, request, metadata, resource, …): the block is the payload
        return {"page_id": None, "url": url, "record_type": kind, "refers_to": None, "payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest(), "payload": block}
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if size is None:
        size = len(payload)
    if kind == "response" and not digest:
        digest = hashlib.sha256(payload).hexdigest()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload differs from its length or WARC-Payload-Digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise WarcError("a revisit with a payload or without WARC-Refers-To")
    number = lambda k: int(headers[k]) if k in headers else None
    return {
        "page_id": number("x-page-id"), "url": None if url is None or url.startswith("urn:page:") else url, "record_type": kind,
        "refers_to": number("x-refers-to-page"), "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def read_frames(source) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an open archive, a frame at a time."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise WarcError("the archive doesn't start with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    data = source.read(size)
    if len(data) != size:
        raise WarcError("the dictionary frame is cut short")
    decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
    at, left = 8 + size, b""
    while left := left or source.read(READ_BYTES):
        frame, parts, used = decoder.decompressobj(), [], 0
        while not frame.eof:
            if not left and not (left := source.read(READ_BYTES)):
                raise WarcError(f"the frame at {at} is cut short")
            parts.append(frame.decompress(left))
            used += len(left) - len(frame.unused_data)
            left = frame.unused_data
        yield at, b"".join(parts)
        at += used


def plan_records(pages: DataFrame, *, min_revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, refers_to, is_revisit: which row of equal payloads keeps the payload.

    Groups are found by a partially aggregated pass over digests; only digests that occur twice
    come to the join, in which adaptive execution splits a hot digest.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    large, small = (rows.where(c) for c in (F.octet_length("payload") >= min_revisit_bytes, F.octet_length("payload") < min_revisit_bytes))
    large = large.withColumn("digest", F.sha2("payload", 256))
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    met = large.join(first, "digest", "left").select("page_id", "url", "payload", F.when(later, F.col("first_id")).alias("refers_to"), later.alias("is_revisit"))
    return met.union(small.select("page_id", "url", "payload", F.lit(None).cast("long"), F.lit(False)))


def write_archives(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", level: int = 3, min_revisit_bytes: int = 100) -> DataFrame:
    """Write an archive per task to ``folder``; file and records of each archive."""
    arrow_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    # drawn by a hash first, so that few rows reach the driver from however many partitions
    ticks, draw = 1 << 40, F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 40))
    share = min(1.0, 2 * DICT_SAMPLE_ROWS / max(1, pages.count()))
    drawn = pages.where(F.col("html").isNotNull() & (draw < int(share * ticks))).select(F.substring("html", 1, 8192).alias("html"), draw.alias("draw"))
    dictionary = train_dictionary([r.html.encode() for r in drawn.orderBy("draw", "html").limit(DICT_SAMPLE_ROWS).collect()])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        task, records = TaskContext.get(), 0
        uri = f"{folder}/part-{task.partitionId():06d}.warc.zst"
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True)
        with replacing(uri, str(task.taskAttemptId())) as sink:
            sink.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
            while first is not None:
                cols = [c.cast(pa.binary()).to_pylist() if c.type in (pa.string(), pa.large_string()) else c.to_pylist() for c in first.columns]
                for page_id, url, payload, refers_to, is_revisit in zip(*cols, strict=True):
                    sink.write(packer.compress(make_record(page_id, url.decode() if url else None, payload, refers_to, date, is_revisit)))
                records += first.num_rows
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"file": [uri], "records": [records]})

    return stash(plan_records(pages, min_revisit_bytes=min_revisit_bytes).mapInArrow(write, WRITTEN), "warc-files")


def read_archives(files: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record of the archives named in ``file``; ``payloads`` false leaves the payload out (null).

    Records other than responses and revisits have their block as payload. Raises WarcError on a broken archive.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        kinds = pa.schema([(n, arrow[kind]) for n, kind in (c.split(" ") for c in READ.split(", "))])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with opened(uri) as source:
                    for at, data in read_frames(source):
                        rows.append({"file": uri, "record_offset": at} | parse_record(data))
                        if not payloads:
                            rows[-1]["payload"] = None
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) == 1000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    spread = files.select("file").repartition(max(1, files.count()))
    return spread.mapInArrow(read, READ)


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archives(pages, new_folder(spark, "warc"))
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
     f AS (SELECT d, min(page_id) AS first_id FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND q.n >= 100
"""
