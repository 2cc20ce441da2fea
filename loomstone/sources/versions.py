"""Tables that are kept as versions: files are only added, and a manifest, swapped at the end, names those that count.

A manifest is a small Parquet table (a row for each part of the table) in ``<path>/manifest/v=<n>``. It is
written under another name and takes its own by a rename that fails where the version exists, so a
write that breaks off leaves no trace in what readers see, and of two writers one fails.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionExists(RuntimeError):
    """Another writer has made this version first."""


class Store:
    """The file system of a path, as the session knows it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def names(self, at: str) -> list[str]:
        path = self._path(f"{self.root}/{at}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def rename_new(self, old: str, new: str) -> None:
        """Rename a folder to a name that must be free."""
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}"), options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise VersionExists(new) from e
            raise

    def remove(self, at: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{at}"), True)


def versions(store: Store) -> list[int]:
    return sorted(int(m[1]) for n in store.names("manifest") if (m := re.fullmatch(r"v=(\d+)", n)))


def current(store: Store) -> int:
    """The newest version, 0 where there is none."""
    return max(versions(store), default=0)


def publish(store: Store, manifest: DataFrame, version: int) -> None:
    """Make a manifest the table's version."""
    part = f"manifest/_{uuid.uuid4().hex}"
    manifest.coalesce(1).write.parquet(f"{store.root}/{part}")
    try:
        store.rename_new(part, f"manifest/v={version}")
    except VersionExists:
        store.remove(part)
        raise


def manifest(spark: SparkSession, store: Store, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{store.root}/manifest/v={version or current(store)}")


def vacuum(spark: SparkSession, store: Store, *folders: str, keep: int = 1) -> int:
    """Remove all but the newest versions and the folders under ``folders`` that none of those names; their number.

    The manifest's column ``folder`` says what a version uses. Not while a write is under way.
    """
    all_versions = versions(store)
    kept = all_versions[-keep:] if keep else []
    used = {r.folder for v in kept for r in manifest(spark, store, v).select("folder").distinct().toLocalIterator()}
    for v in all_versions[: len(all_versions) - len(kept)]:
        store.remove(f"manifest/v={v}")
    gone = [f"{top}/{n}" for top in folders for n in store.names(top) if f"{top}/{n}" not in used]
    for at in gone:
        store.remove(at)
    return len(gone)
