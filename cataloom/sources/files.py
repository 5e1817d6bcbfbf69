"""Files below folders as a Spark data source.

``register(spark)``, then ``spark.read.format("cataloom_files").load(folder)``
(or the option ``roots``, a JSON list) gives the rows of ``inventory.walk``.
With the option ``under``, a JSON list, only paths that begin with one of
these prefixes are rows, and no folder is opened that can't hold one.

The prefixes are an option and not a pushed filter, as Spark 4.1 keeps a
Python reader with its filters for later queries on the same DataFrame: one
without a filter that can be pushed would get the rows of the one before.

The driver opens upper folders, a bounded number of entries, until there are
enough subtrees to deal out. One very large subtree stays one task: for a
tree that is not known to spread, ``walk`` hands work on between rounds.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cataloom.sources.inventory import _CHUNK, UnreadableFolder, _entries, outermost, require_root

NAME = "cataloom_files"
SCHEMA = "origin_path string, length long, mtime timestamp"
_ARROW = pa.schema([("origin_path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
#: Entries that planning reads at most, and partitions that it makes at most
#: (option ``tasks``).
PLANNED_ENTRIES, TASKS = 10_000, 256


@dataclass
class Folders(InputPartition):
    """Folders of which a task lists the files, and those that it goes down into."""
    flat: list[str]
    deep: list[str]


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = outermost(json.loads(options["roots"]) if "roots" in options else [options["path"]])
        self.tasks = int(options.get("tasks", TASKS))
        self.under = tuple(json.loads(options["under"])) if "under" in options else ("",)

    def _below(self, folder: str) -> bool:
        """Whether a path that is asked for can lie below ``folder``."""
        inside = folder.rstrip(os.sep) + os.sep
        return any(inside.startswith(p) or p.startswith(inside) for p in self.under)

    def partitions(self) -> list[Folders]:
        for root in self.roots:
            require_root(root)
        opened, waiting, left = [], [r for r in self.roots if self._below(r)], PLANNED_ENTRIES
        while waiting and len(waiting) < self.tasks and left > 0:
            inside = []
            try:
                for path, kind, _, _ in _entries(waiting[0]):
                    left -= 1
                    if left < 0:
                        break
                    if kind == "dir" and self._below(path):
                        inside.append(path)
            except OSError as err:
                raise UnreadableFolder(f"{waiting[0]}: {err.strerror}") from err
            if left >= 0:  # seen to its end: its files are left to a task
                opened.append(waiting.pop(0))
                waiting += inside
        dealt = [Folders(opened[i::self.tasks], waiting[i::self.tasks]) for i in range(self.tasks)]
        return [p for p in dealt if p.flat or p.deep] or [Folders([], [])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        stack, rows = [(f, False) for f in partition.flat] + [(f, True) for f in partition.deep], []
        while stack:
            folder, down = stack.pop()
            try:
                for path, kind, length, mtime in _entries(folder):
                    if kind == "dir":
                        if down and self._below(path):
                            stack.append((path, True))
                    elif path.startswith(self.under):
                        rows.append((path, length, int(mtime * 1e6)))
                        if len(rows) >= _CHUNK:
                            yield _batch(rows)
                            rows = []
            except OSError as err:
                raise UnreadableFolder(f"{folder}: {err.strerror}") from err
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class FilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    spark.dataSource.register(FilesDataSource)
