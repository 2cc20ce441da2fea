"""What the training-data operators share: the shared work folder, lineage cuts, files from workers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path, by the file system that Spark would take for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(at).toString()


_roots: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """This session's folder in the shared store; it is removed when Python ends.

    The cluster names the store in ``spark.checkpoint.dir``. Where that is unset, as in tests, the
    warehouse (shared as well) holds it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loomstone_work"
    if base not in _roots:
        _roots[base] = f"{qualified(spark, base).rstrip('/')}/loomstone-{_RUN}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_roots[base])
        atexit.register(_clean, _roots[base], path, spark.sparkContext._jsc.hadoopConfiguration())
    return _roots[base]


def _clean(uri: str, path, conf) -> None:
    local = local_path(uri)
    if local:
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 the session's JVM has ended before, and with it the way to the store
        return


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{work_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Stashed tables after which the driver lets go of what it no longer needs.
LET_GO_EACH = 8
_stashed = [0]


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark removes the shuffle files and broadcasts of plans that are done
    when the driver has forgotten them, which an idle driver does every half hour only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stash(df: DataFrame, tag: str, *, narrow: bool = False) -> DataFrame:
    """Write to the shared store and read again: the lineage ends there, and any executor can read it.

    ``narrow``, for tables of ids: at most four files for each core of the cluster, not one for each
    shuffle partition. Every few tables what was shuffled for earlier ones is let go.
    """
    spark = df.sparkSession
    _stashed[0] += 1
    if _stashed[0] % LET_GO_EACH == 0:
        let_go(spark)
    path = new_folder(spark, tag)
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the files of a stashed table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"loomstone-{_RUN}" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch between the JVM and Python holds, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


_held: dict[tuple, object] = {}


def held(*key, build=None):
    """What ``build`` makes, kept in this worker for its next tasks; only the last such object is kept.

    Workers serve one operator after another; without a key all is let go.
    """
    if not key or key not in _held:
        _held.clear()
        if key:
            _held[key] = build()
    return _held.get(key)


def local_path(uri: str) -> str | None:
    """The path of a folder that is mounted here (no scheme, or file:), else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


@contextmanager
def replacing(uri: str, attempt: str):
    """A binary sink under a name of this attempt that takes its final name when complete.

    A task that is run again, or twice at once, leaves one whole file.
    """
    part = f"{uri}.{attempt}.tmp"
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(part), "wb") as sink:
            yield sink
        os.replace(local_path(part), path)
        return
    from pyarrow import fs

    store, to = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(to), recursive=True)
    with store.open_output_stream(f"{to}.{attempt}.tmp") as sink:
        yield sink
    store.move(f"{to}.{attempt}.tmp", to)


def opened(uri: str):
    """A binary source that can be read in pieces."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(at)
