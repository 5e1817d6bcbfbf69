"""A catalog table whose changes are appended beside its snapshots.

A batch of changes is one plain write to a folder of its own, which Spark
marks as complete at its end. Readers fold the complete batches into the
snapshot; the next snapshot names those that it holds. Appending needs no
claim and meets no conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cataloom.operators.changes import CHANGE, fold
from cataloom.schema import SCHEMAS
from cataloom.sources.store import SnapshotStore


class Version(int):
    """The number of a snapshot, with the batches that were open beside it
    when it was looked up: what is read and what the next snapshot holds."""

    runs: tuple[str, ...] = ()


class ChangedTable(SnapshotStore):
    def _complete(self) -> list[str]:
        path, fs = self._fs("changes", "*", "_SUCCESS")
        return sorted(status.getPath().getParent().getName() for status in fs.globStatus(path) or [])

    def _held(self, folder: str) -> set[str]:
        """Batches that a snapshot holds already."""
        name = folder.rsplit("/", 1)[-1]
        path, fs = self._fs("held", name)
        spark = SparkSession.active()
        # as many rows as there were batches between two compactions
        return {r[0] for r in spark.read.schema("run string").parquet(f"{self.root}/held/{name}").collect()} if fs.exists(path) else set()

    def current(self) -> Version | None:
        number = super().current()
        if number is None:
            return None
        version = Version(number)
        held = self._held(self._folder(number))
        version.runs = tuple(run for run in self._complete() if run not in held)
        return version

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The snapshot with the open batches of ``version`` folded in (a
        plain number: the snapshot alone)."""
        version = self.current() if version is None else version
        rows = super().read(spark, version)
        runs = getattr(version, "runs", ())
        if not runs:
            return rows
        return fold(rows, spark.read.schema(CHANGE).parquet(*[f"{self.root}/changes/{run}" for run in runs]))

    def append(self, run: str, changes: DataFrame) -> None:
        """Write a batch, once: a run that is recorded again adds nothing. What
        a writer that died has left of it is replaced. A batch that was folded
        in and deleted since is known by its name."""
        path, fs = self._fs("applied", run)
        if run not in self._complete() and not fs.exists(path):
            changes.write.mode("overwrite").parquet(f"{self.root}/changes/{run}")

    def _prepare(self, folder: str, expected: int | None) -> None:
        runs = set(getattr(expected, "runs", ()))
        if expected is not None:
            runs |= self._held(self._folder(expected)) & set(self._complete())
        spark = SparkSession.active()
        spark.createDataFrame([(run,) for run in sorted(runs)], "run string").coalesce(1).write.parquet(f"{self.root}/held/{folder.rsplit('/', 1)[-1]}")

    def compact(self, spark: SparkSession) -> int | None:
        """Publish a snapshot that holds all open batches, and delete the
        batches that the snapshot before it held already: nobody who reads
        that one or this one looks at them."""
        version = self.current()
        if version is None or not version.runs:
            return version
        old = self._held(self._folder(version))
        made = self.publish(self.read(spark, version).select(*SCHEMAS[self.table].fieldNames()), version)
        for run in old:
            mark, fs = self._fs("applied", run)
            fs.create(mark, True).close()
            path, fs = self._fs("changes", run)
            fs.delete(path, True)
        return made
