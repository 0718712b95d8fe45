"""Keyed tables in versions: rows are merged by key, and a commit takes effect whole or not at all.

A table is dealt into buckets by a hash of its keys. A version is a manifest, a small file that names the folder of each
bucket's rows. A commit reads and rewrites only the buckets that its changes touch, and then puts the next manifest in place by a
rename that fails if there is one already: of two writers that started from the same version one loses, and nothing of it
shows. Each manifest has the epoch of its writer and the last batch that the writer merged, so that a batch that runs again
changes nothing and a writer of an older epoch is refused. Folders that no kept manifest names are removed.

The rename is one step on file systems with a name space of their own (HDFS, local disks); on object stores it takes a
committer that gives the same promise.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, KEPT_VERSIONS = 16, 3


class Manifest(NamedTuple):
    """A version: its writer's epoch and last batch, and the folder of each bucket that has rows."""

    version: int
    epoch: int
    batch: int
    folders: dict[str, str]


class _Files:
    """The few file operations that a commit needs, on whatever file system the path is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        folder = self.at(path)
        return [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, path: str, content: str) -> bool:
        """Write a file that was not there; False if it is."""
        folder, name = path.rsplit("/", 1)
        waiting = self.at(f"{folder}/.{name}-{uuid.uuid4()}")
        stream = self.fs.create(waiting, True)
        stream.write(bytearray(content.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(waiting), self.fs.makeQualified(self.at(path)), plain)
        except Exception as error:
            self.fs.delete(waiting, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class KeyedTable:
    """Rows by key below a path; `keys` are columns of all that is merged."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = BUCKETS, kept: int = KEPT_VERSIONS) -> None:
        self.spark, self.path, self.keys, self.buckets, self.kept = spark, path.rstrip("/"), keys, buckets, kept
        self.files = _Files(spark, self.path)

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        return sorted(int(n[1:-5]) for n in self.files.names(f"{self.path}/manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """One version's manifest, or the newest one's; None for a table without a version."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        return Manifest(**json.loads(self.files.read(self._place(known[-1] if version is None else version))))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None for a table without rows."""
        found = self.manifest(version)
        return self._rows(found.folders.values()) if found else None

    def commit(self, changes: DataFrame, merge: Merge, *, batch: int, epoch: int = 0) -> str:
        """Merge changes by `merge`(rows of the touched buckets or None, changes); gives what became of them.

        `applied`; `replayed`: this writer merged the batch before; `fenced`: a newer epoch has written; `conflict`: another
        writer was first, try again.
        """
        now = self.manifest()
        if now and now.epoch > epoch:
            return "fenced"
        if now and now.epoch == epoch and batch <= now.batch:
            return "replayed"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        touched = {r[0] for r in changes.select(bucket.alias("b")).distinct().collect()}
        folders = dict(now.folders) if now else {}
        before = self._rows([folders[b] for b in touched if b in folders])
        version = (now.version if now else 0) + 1
        name = f"{self.path}/data/{version}-{uuid.uuid4()}"
        if touched:
            merge(before, changes).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(name)
            written = {n.split("=")[1] for n in self.files.names(name) if n.startswith("_bucket=")}
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{name}/_bucket={b}" for b in written}
        new = Manifest(version, epoch, batch, folders)
        if not self.files.put_new(self._place(version), json.dumps(new._asdict())):
            self.files.remove(name)
            return "conflict"
        self._forget()
        return "applied"

    def _place(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:012d}.json"

    def _rows(self, folders) -> DataFrame | None:
        paths = sorted(folders)
        return self.spark.read.parquet(*paths) if paths else None

    def _forget(self) -> None:
        """Remove versions beyond the newest `kept`, and folders of rows that only they name."""
        known = self.versions()
        gone, stay = known[: -self.kept], known[-self.kept :]
        if not gone:
            return
        named = {f for v in stay for f in self.manifest(v).folders.values()}
        for version in gone:
            for folder in set(self.manifest(version).folders.values()) - named:
                self.files.remove(folder)
        for version in gone:
            self.files.remove(self._place(version))
