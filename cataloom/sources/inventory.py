"""What is on storage: a parallel directory walk and an existence probe.

The walk lists regular files only, hidden and empty ones included, and does
not follow symbolic links (a link is neither a file nor a folder entry).
Spark's ``binaryFile`` source is not used: it drops empty files and names
starting with ``_`` or ``.``, and it follows links.

Executors must see the same mounted file system as the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("length", T.LongType(), True),
    T.StructField("mtime", T.DoubleType(), True),
])
_CHUNK = 10_000


def require_root(root: str) -> None:
    """Stop before any job when the folder to sync does not exist."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"folder to sync does not exist: {root}")


class UnreadableFolder(OSError):
    """A folder below a root could not be listed, so what is there is unknown."""


def outermost(roots: list[str]) -> list[str]:
    """The roots that lie in no other root, so that no file is listed twice."""
    paths = sorted({os.path.normpath(r) for r in roots})
    return [p for p in paths if not any(p != q and p.startswith(q.rstrip(os.sep) + os.sep) for q in paths)]


def _entries(folder: str):
    """Entries of a folder; one that vanishes meanwhile is left out alone."""
    with os.scandir(folder) as it:
        for e in it:
            try:
                if e.is_dir(follow_symlinks=False):
                    yield e.path, "dir", None, None
                elif e.is_file(follow_symlinks=False):
                    st = e.stat(follow_symlinks=False)
                    yield e.path, "file", st.st_size, st.st_mtime
            except FileNotFoundError:
                continue


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "kind", "length", "mtime"]).astype(
        {"length": "Int64", "mtime": "float64"})


def _walker(budget: int):
    """Lists the folders of a task and what is below them, depth first, until
    ``budget`` entries are seen; folders still to be listed are handed on as
    ``dir`` rows. Rows leave in chunks, also within one large folder."""
    def run(batches):
        rows, seen = [], 0
        for pdf in batches:
            stack = list(pdf["path"])
            while stack:
                if seen >= budget:
                    rows += [(folder, "dir", None, None) for folder in stack]
                    break
                folder = stack.pop()
                try:
                    for entry in _entries(folder):
                        seen += 1
                        if entry[1] == "dir":
                            stack.append(entry[0])
                            continue
                        rows.append(entry)
                        if len(rows) >= _CHUNK:
                            yield _frame(rows)
                            rows = []
                except OSError as err:
                    rows.append((f"{folder}: {err.strerror}", "unreadable", None, None))
        yield _frame(rows)
    return run


def walk(spark: SparkSession, roots: list[str], budget: int = 50_000) -> DataFrame:
    """Inventory ``(origin_path, length, mtime)`` of every regular file below
    ``roots``; roots inside other roots are listed with those.

    Each round lists the open folders as a distributed job; a task goes down
    into their subtrees for ``budget`` entries and hands the rest on, so deep
    and large trees spread over all tasks. Each round is checkpointed: a lost
    executor never re-lists earlier rounds. A very large flat folder is
    listed by one task, in chunks. A folder that can't be listed stops the
    walk with ``UnreadableFolder``, as nothing is known about its files."""
    roots = outermost(roots)
    for root in roots:
        require_root(root)
    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(r,) for r in roots], "path string")
    found, first = None, True
    while True:
        # the roots' own entries are few: the first round only opens them
        listed = frontier.mapInPandas(_walker(1 if first else budget), _ENTRY).checkpoint()
        unreadable = listed.where(F.col("kind") == "unreadable")
        bad = [r["path"] for r in unreadable.limit(20).collect()]
        if bad:
            raise UnreadableFolder(f"{unreadable.count()} folders can't be listed, such as {'; '.join(bad)}")
        files = listed.where(F.col("kind") == "file")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where(F.col("kind") == "dir").select("path")
        n = frontier.count()
        if not n:
            break
        frontier, first = frontier.repartition(min(n, tasks)), False
    return found.select(F.col("path").alias("origin_path"), "length",
                        F.col("mtime").cast("timestamp").alias("mtime"))


#: Rows whose paths are asked for together: bounds what a task holds.
_ASKED_ROWS, _ASKED_BYTES = 100_000, 64 << 20
#: Fewer names of a folder are asked for one by one; a listing reads at most
#: so many entries for each name that it is to answer.
_LIST_FROM, _LIST_RATIO = 4, 32
_PATH_MAX = 4096
_ROW, _FOLDER = "_probe_row", "_probe_folder"


def _listed_names(folder: str, names: set[str]) -> tuple[set[str], bool]:
    """Those of ``names`` that the folder has (links, which may point nowhere,
    left out), and whether it has no other. One listing, cut short where it
    would cost more than asking."""
    there, left = set(), set(names)
    try:
        with os.scandir(folder or ".") as it:
            for seen, entry in enumerate(it):
                if seen >= _LIST_RATIO * len(names):
                    return there, False
                if entry.name in left:
                    left.discard(entry.name)
                    if entry.is_symlink():
                        if os.path.exists(entry.path):
                            there.add(entry.name)
                    else:
                        there.add(entry.name)
                    if not left:
                        break
    except (FileNotFoundError, NotADirectoryError):
        return set(), True
    except OSError:  # may be entered, but not listed
        return there, False
    return there, True


def existing_paths(paths: Iterable[str]) -> set[str]:
    """Those of ``paths`` (in any order) that exist, as ``os.path.exists``
    tells: one listing for each folder with several of them, one call for
    each other path."""
    folders: dict[str, set[str]] = {}
    for path in set(paths):
        head, sep, name = path.rpartition("/")
        folders.setdefault(head + sep, set()).add(name)
    out = set()
    for folder, names in folders.items():
        # what a listing doesn't name, and what is too long to be a path, is asked for
        listable = {n for n in names if n not in ("", ".", "..") and len(os.fsencode(folder + n)) < _PATH_MAX}
        alone = names
        if len(listable) >= _LIST_FROM:
            there, whole = _listed_names(folder, listable)
            out.update(folder + n for n in there)
            alone = names - (listable if whole else there)
        out.update(folder + n for n in alone if os.path.exists(folder + n))
    return out


def _asker(path_at: int, flag_at: int):
    """Sets the flag of sorted rows, a bounded number of them at a time."""
    def answered(pending):
        there = existing_paths(p for batch in pending for p in batch.column(path_at).to_pylist())
        for batch in pending:
            flags = pa.array([True if p in there else None for p in batch.column(path_at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([flags if i == flag_at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    def run(batches):
        pending, rows, size = [], 0, 0
        for batch in batches:
            pending.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= _ASKED_ROWS or size >= _ASKED_BYTES:
                yield from answered(pending)
                pending, rows, size = [], 0, 0
        yield from answered(pending)
    return run


def by_folder(df: DataFrame, path_col: str, row_col: str) -> DataFrame:
    """Rows side by side by folder and path. Ranges, not a hash: a folder, or
    a path, that very many rows share is split by path and then by row."""
    path = F.col(path_col)
    folder = path.substr(F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))
    return (df.withColumn(_FOLDER, folder).repartitionByRange(_FOLDER, path_col, row_col)
            .sortWithinPartitions(_FOLDER, path_col).drop(_FOLDER))


def probe_missing(df: DataFrame, path_col: str, flag_col: str) -> DataFrame:
    """Fill ``flag_col`` (True or NULL) by asking the file system for the rows
    the inventory join left unmatched; matched rows, and those without a path,
    make no system call and aren't moved.

    Paths are asked for by folder: one listing answers for all names asked of
    it, unless the folder is far larger than their number; a folder that has
    gone costs one call. The answers are written once (checkpoint), so what
    reads them later asks nothing again."""
    names, known = df.columns, F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False))
    df = df.withColumn(flag_col, F.when(known, F.lit(True))).withColumn(_ROW, F.monotonically_increasing_id()).checkpoint()
    open_ = F.col(flag_col).isNull() & F.col(path_col).isNotNull()
    asked = by_folder(df.where(open_), path_col, _ROW).select(*names)
    answers = asked.mapInArrow(_asker(names.index(path_col), names.index(flag_col)), asked.schema).checkpoint()
    return df.where(~open_).select(*names).unionByName(answers)
