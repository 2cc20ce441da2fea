"""One read that parts good rows from bad ones, and one file for each record, complete or not there.

Bad rows aren't dropped: each is counted with its file, its line and why it is bad. Files of records are
written by a data source with a commit in two steps: tasks write under a folder of the job that no
reader looks at, and the commit moves the folders of the attempts that count to their place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.text import slug
from ..operators.sequence import number_in_group
from ..session import spread
from .tables import write_and_read


# --- reading
def parted_lines(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (with file_name), and the bad lines: file_name, line (from 1), reason, value.

    A line is bad if it is no JSON, no object, lacks a required field, or has a field that isn't of its
    type. Blank lines are no rows. Lines are read once, numbered as they are read, and written.
    """
    kinds = _parse_datatype_string(schema)
    at = F.monotonically_increasing_id()
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    v = F.try_parse_json("value")
    cells = {f.name: F.try_variant_get("v", f"$['{f.name}']", f.dataType.simpleString()) for f in kinds}
    raw = {f.name: F.try_variant_get("v", f"$['{f.name}']", "variant") for f in kinds}
    there = lambda n: raw[n].isNotNull() & ~F.coalesce(F.is_variant_null(raw[n]), F.lit(True))
    lacking = [F.when(~there(n), F.lit(f"no {n}")) for n in required or []]
    odd = [F.when(there(n) & c.isNull(), F.lit(f"bad {n}")) for n, c in cells.items()]
    reason = F.when(F.col("v").isNull(), "not JSON").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "no object").otherwise(F.coalesce(*lacking, *odd, F.lit("")))
    parsed = read.withColumn("v", v).select("file", "file_name", "block", "at", "value", F.struct(*[c.alias(n) for n, c in cells.items()]).alias("row"), reason.alias("reason"))
    blank = F.trim("value") == ""
    kept = write_and_read(parsed.select("file", "file_name", "block", "at", F.when(blank, "blank").otherwise(F.col("reason")).alias("reason"), F.when(F.col("reason") != "", F.col("value")).alias("value"), F.when((F.col("reason") == "") & ~blank, F.col("row")).alias("row")), "lines")
    good = kept.where("reason = ''").select("row.*", "file_name")
    splits = kept.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each part of a file
    earlier = splits.alias("a").join(splits.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("b.block") < F.col("a.block")), "left").groupBy("a.file", "a.block", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    bad = kept.where("reason NOT IN ('', 'blank')").join(earlier, ["file", "block"])
    return good, bad.select("file_name", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "reason", "value")


def bad_counts(bad: DataFrame) -> DataFrame:
    """file_name, reason, n."""
    return bad.groupBy("file_name", "reason").agg(F.count("*").alias("n"))


# --- writing
def _opened(root: str):
    """A folder's store, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class RecordWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root.rstrip("/"), job

    def _store(self):
        return _opened(self.root)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = self._store()
        folder, n = f"_{self.job}/{uuid.uuid4().hex}", 0
        store.create_dir(f"{root}/{folder}", recursive=True)
        for row in iterator:
            with store.open_output_stream(f"{root}/{folder}/{row.name}") as sink:
                sink.write(bytes(row.content))
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves the folder of each task that wrote, and forgets the attempts that don't count."""
        store, root = self._store()
        for part, m in enumerate(m for m in messages if m is not None and m.files):
            store.move(f"{root}/{m.folder}", f"{root}/{self.job}-{part:05d}")
        store.delete_dir(f"{root}/_{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        if store.get_file_info(f"{root}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_{self.job}")


class RecordFiles(DataSource):
    """Writes rows (name string, content binary) to files under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "loomstone_record_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options["path"], f"job-{uuid.uuid4().hex}")


def write_records(df: DataFrame, path: str, name: Column, content: Column, *, order: str | list[str], ending: str = "") -> DataFrame:
    """Write a file for each row; the rows' names and files: ``order``, nth (among rows of the same slug, from 0), file_name.

    Names are slugs. Names that come again get __1, __2 … in ``order``, so no file is written twice; rows
    without a content get no file. Files lie in a folder for each task under ``path``, all or none of a job's.
    """
    spark = df.sparkSession
    order = [order] if isinstance(order, str) else list(order)
    rows = df.select(F.struct(*order).alias("order"), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("unnamed")).alias("slug"), content.cast("binary").alias("content")).where("content is not null")
    numbered = number_in_group(rows, "slug", "order", "nth", few=10_000)
    named = numbered.select("order", "nth", F.concat("slug", F.when(F.col("nth") > 0, F.concat(F.lit("__"), F.col("nth").cast("string"))).otherwise(""), F.lit(ending)).alias("name"), "content")  # of rows that are written: the same however often it is made
    spark.dataSource.register(RecordFiles)
    named.select("name", "content").write.format("loomstone_record_files").mode("append").option("path", path).save()
    return named.select("order.*", "nth", F.col("name").alias("file_name"))


#: Bytes of files that a task gives on at a time.
BATCH_BYTES = 4 << 20


def _names(root: str, empty: bool):
    """For folders under root (folder): folder, name of each file; of empty ones if they are asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = _opened(root)
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            names = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}")) if i.type == fs.FileType.File and (i.size or empty)]
            yield pa.RecordBatch.from_arrays([pa.array([folder] * len(names), pa.string()), pa.array(names, pa.string())], ["folder", "name"])

    return work


def _contents(root: str):
    """For files (folder, name): file_name, content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(root)
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["file_name", "content"])
        held, size = [], 0
        for folder, name in ((f, n) for b in batches for f, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            with store.open_input_stream(f"{base}/{folder}/{name}") as source:
                held.append((name, source.read()))
            size += len(held[-1][1])
            if size > BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        yield batch(held)

    return work


def read_records(spark: SparkSession, path: str, *, empty: bool = False) -> DataFrame:
    """file_name, content of the files that were written; those of jobs under way aren't seen, empty ones if asked for.

    The driver lists the jobs' folders alone; tasks list the files in them, and read them dealt out anew.
    """
    from pyarrow import fs

    root = path.rstrip("/")
    store, base = _opened(root)
    folders = sorted((i.base_name,) for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name.startswith("job-"))
    listed = spark.createDataFrame(folders, "folder string").repartition(max(1, len(folders))).mapInArrow(_names(root, empty), "folder string, name string")
    return spread(listed).mapInArrow(_contents(root), "file_name string, content binary")


def copy_matching(spark: SparkSession, files: str | DataFrame, to: str, match: Callable[[Column], Column]) -> DataFrame:
    """Copy the files whose text fits a condition, unchanged and under their names; file_name of each.

    ``files`` is a folder or pattern of files with names of their own, or rows as ``read_records`` gives them.
    """
    if isinstance(files, str):
        files = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "content")
    named = write_and_read(files.where(match(F.col("content").cast("string"))).select(F.col("file_name").alias("name"), "content"), "matching")
    spark.dataSource.register(RecordFiles)
    named.write.format("loomstone_record_files").mode("append").option("path", to).save()
    return named.select(F.col("name").alias("file_name"))
