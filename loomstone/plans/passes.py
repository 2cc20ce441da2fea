"""A download pass: a stream of records becomes manifest rows, files of full texts, and failures.

Every record is appended to the manifest with the pass's name, so a pass that is run again shows there
twice. Records that can be downloaded and haven't been are fetched, a bounded number at a time in each
task; what comes back is written once before it is used. Raw files and texts are written all or none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements
from ..sources.paged import Fetch, FetchError, Request
from ..sources.records import write_records
from ..sources.tables import write_and_read

FETCHED = "record_id string, content binary, error string, status int"


def fetch_all(ids: DataFrame, request: Callable[[str], Request], fetch: Fetch, *, at_once: int = 8) -> DataFrame:
    """record_id, content, error, status of each different id (record_id); ``request`` makes the request of an id."""

    def one(name: str) -> tuple:
        try:
            return fetch(request(name)).body, None, 200
        except FetchError as e:
            return None, str(e), e.status
        except Exception as e:  # noqa: BLE001 whatever a fetch raises is its record's error
            return None, f"{type(e).__name__}: {e}", None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                names = batch.column(0).to_pylist()
                rows = list(pool.map(one, names))
                cells = [pa.array(names, pa.string()), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.int32()))]]
                yield pa.RecordBatch.from_arrays(cells, ["record_id", "content", "error", "status"])

    return write_and_read(ids.select("record_id").distinct().mapInArrow(work, FETCHED), "fetched")


@dataclass
class Pass:
    """What a pass leaves: counts (a row), fetched (record_id, content), failures (record_id, error, status, retryable)."""

    counts: DataFrame
    fetched: DataFrame
    failures: DataFrame


def run_pass(records: DataFrame, name: str, record_id: Column, request: Callable[[str], Request], fetch: Fetch, root: str, done: DataFrame, *, most: int | None = None, texts: bool = True) -> Pass:
    """Run a pass over typed articles into folders under ``root``: manifest, raw (XML), texts, failures.

    ``record_id`` is null for what can't be downloaded; ``done`` has the record_id of what is there already.
    With ``most``, the first so many by record_id are fetched. Repeated records are fetched once.
    """
    rows = write_and_read(records.withColumn("doc_type", F.lit(name)).withColumn("record_id", record_id), "pass")
    rows.drop("record_id").write.mode("append").parquet(f"{root}/manifest")
    wanted = rows.where("record_id is not null").select("record_id").distinct()
    todo = wanted.join(done.select("record_id").distinct(), "record_id", "left_anti")
    todo = todo.orderBy("record_id").limit(most) if most is not None else todo
    got = fetch_all(todo, request, fetch)
    fetched, failures = got.where("error is null").select("record_id", "content"), got.where("error is not null").select("record_id", "error", "status", (F.coalesce("status", F.lit(0)) >= 500).alias("retryable"))
    write_records(fetched, f"{root}/raw", F.col("record_id"), F.col("content"), order="record_id", ending=".xml")
    failures.write.mode("append").parquet(f"{root}/failures")
    if texts:
        body = elements.journal_text(elements.elements(fetched.select("record_id", F.col("content").cast("string").alias("xml")), "record_id", "xml"), "record_id")
        first = rows.where("record_id is not null").groupBy("record_id").agg(F.min(F.struct("id", "source", "title", "doi", "pmcid")).alias("m"))
        said = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
        head = F.concat_ws("\n", said("DOC_TYPE", F.lit(name)), said("TITLE", F.col("m.title")), said("PMCID", F.col("m.pmcid")), said("DOI", F.col("m.doi")), said("ID", F.concat_ws(":", "m.source", "m.id")), F.lit("-" * 80), F.coalesce("text", F.lit("")))
        made = fetched.join(first, "record_id").join(body, "record_id", "left").select("record_id", head.alias("text"))
        write_records(made, f"{root}/texts", F.col("record_id"), F.col("text"), order="record_id", ending=".txt")
    count = lambda df: df.agg(F.count("*").alias("n"))
    parts = {"streamed": rows, "not_downloadable": rows.where("record_id is null"), "already": wanted.join(done.select("record_id").distinct(), "record_id", "left_semi"), "downloaded": fetched, "failed": failures}
    tallies = None
    for label, df in parts.items():
        own = count(df).select(F.lit(label).alias("label"), "n")
        tallies = own if tallies is None else tallies.union(own)
    return Pass(tallies, fetched, failures)


def request_of(base: str):
    """The request of a record's full text."""
    return lambda record_id: Request(f"{base}/{record_id}/fullTextXML")
