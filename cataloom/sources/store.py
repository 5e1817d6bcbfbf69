"""Versioned catalog snapshots on a shared folder.

Parquet tables cannot be updated in place, so each mutation writes the next
snapshot into a folder of its own and then claims the next version: a small
file ``versions/00000N.json`` that names the folder and comes into being in
one step that fails if it is there already. Readers never see a half-written
snapshot, of two writers one fails, and what a dead writer left is in nobody's
way. All file operations go through Spark's Hadoop file system, as the data does.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from cataloom.schema import SCHEMAS


class SnapshotConflict(RuntimeError):
    pass


class SnapshotStore:
    def __init__(self, root: str, table: str = "file_list"):
        self.root = root.rstrip("/")
        self.table = table

    def _fs(self, *parts: str):
        spark = SparkSession.active()
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._fs("versions")
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int | None:
        return max(self._versions(), default=None)

    def _folder(self, version: int) -> str:
        path, fs = self._fs("versions", f"{version:06d}.json")
        stream = fs.open(path)
        try:
            said = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return f"{self.root}/{json.loads(said)['folder']}"

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        v = self.current() if version is None else version
        if v is None:
            return spark.createDataFrame([], SCHEMAS[self.table])
        return spark.read.schema(SCHEMAS[self.table]).parquet(self._folder(v))

    def _claim(self, version: int, folder: str) -> bool:
        """Make the version's file, complete and only if there is none: it is
        written under another name and renamed (or, on a local file system,
        where a rename replaces, linked)."""
        name = f"{version:06d}.json"
        tmp, fs = self._fs("versions", f".{name}.{uuid.uuid4().hex}")
        final, _ = self._fs("versions", name)
        stream = fs.create(tmp, False)
        stream.write(bytearray(json.dumps({"folder": folder}).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() != "file":
                return bool(fs.rename(tmp, final))
            java = SparkSession.active()._jvm.java
            link, made = (java.io.File(p.toUri().getPath()).toPath() for p in (final, tmp))
            try:
                java.nio.file.Files.createLink(link, made)
                return True
            except Exception as err:
                if "FileAlreadyExists" in str(err):
                    return False
                raise
        finally:
            fs.delete(tmp, False)

    def _prepare(self, folder: str, expected: int | None) -> None:
        """What else belongs to a written snapshot before its version is claimed."""

    def publish(self, df: DataFrame, expected: int | None) -> int:
        """Write ``df`` as the version after ``expected``."""
        if self.current() != expected:
            raise SnapshotConflict(f"catalog moved on from version {expected} to {self.current()}")
        version = 0 if expected is None else expected + 1
        folder = f"data/{version:06d}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        self._prepare(folder, expected)
        if not self._claim(version, folder):
            path, fs = self._fs(folder)
            fs.delete(path, True)
            raise SnapshotConflict(f"catalog moved on from version {expected} while writing")
        return version
