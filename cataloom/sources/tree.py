"""The walk of a mostly unchanged tree: folders whose stored mark still holds
are not opened.

A stored tree is two tables under one folder: ``folders`` (folder, mark,
opened) and ``files`` (folder, path, length, mtime). The mark of a folder is
its inode with the times of its last change, which move when an entry comes,
goes or is renamed. A folder that changed shortly before it was listed has no
mark, as a later change could bear the same time; it is opened again.
"""

from __future__ import annotations

import os
import stat
import time
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.sources.inventory import _CHUNK, UnreadableFolder, _entries, outermost, require_root

_LISTED = "folder string, path string, kind string, length long, mtime double, mark string"
#: Seconds that a folder must have been at rest for its mark to count.
SETTLED = 2.0


def _mark(st: os.stat_result) -> str:
    return f"{st.st_dev}:{st.st_ino}:{st.st_mtime_ns}:{st.st_ctime_ns}"


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["folder", "path", "kind", "length", "mtime", "mark"]).astype({"length": "Int64", "mtime": "float64"})


def _checker(roots: list[str]):
    """Adds ``state``: same, changed or gone (also below what is now a link)."""
    def run(batches):
        @lru_cache(1 << 16)
        def status(folder):
            if folder not in roots and status(os.path.dirname(folder)) is None:
                return None
            try:
                st = os.lstat(folder)
            except (FileNotFoundError, NotADirectoryError):
                return None
            except OSError:
                return ""
            # a root may be named by a link, which the walk opens
            st = os.stat(folder) if folder in roots and stat.S_ISLNK(st.st_mode) else st
            return _mark(st) if stat.S_ISDIR(st.st_mode) else None

        for pdf in batches:
            now = [status(f) for f in pdf["folder"]]
            pdf["state"] = ["gone" if n is None else "same" if n == m else "changed" for n, m in zip(now, pdf["mark"])]
            yield pdf[["folder", "mark", "state"]]
    return run


def _lister(budget: int, settled: float):
    """Lists folders and, until ``budget`` entries are seen (0: not at all),
    what is below them: file rows, a ``folder`` row with the mark for each folder opened, a
    ``dir`` row for each that is left to be opened."""
    def run(batches):
        rows, seen = [], 0
        for pdf in batches:
            stack = list(pdf["folder"])
            while stack:
                if budget and seen >= budget:
                    rows += [(os.path.dirname(f), f, "dir", None, None, None) for f in stack]
                    break
                folder = stack.pop()
                try:
                    st = os.stat(folder)  # before the listing: a change meanwhile makes the mark differ
                    mark = _mark(st) if time.time() - max(st.st_mtime, st.st_ctime) >= settled else None
                    for path, kind, length, mtime in _entries(folder):
                        seen += 1
                        if kind == "dir" and budget:
                            stack.append(path)
                        else:
                            rows.append((folder, path, kind, length, mtime, None))
                        if len(rows) >= _CHUNK:
                            yield _frame(rows)
                            rows = []
                    rows.append((folder, folder, "folder", None, None, mark))
                except OSError as err:
                    rows.append((folder, f"{folder}: {err.strerror}", "unreadable", None, None, None))
        yield _frame(rows)
    return run


def _again(batches):
    """Length and time of known files as they are now; no folder is opened."""
    for pdf in batches:
        rows = []
        for folder, path in zip(pdf["folder"], pdf["path"]):
            try:
                st = os.lstat(path)
            except (FileNotFoundError, NotADirectoryError):
                continue
            if stat.S_ISREG(st.st_mode):
                rows.append((folder, path, st.st_size, st.st_mtime))
        yield pd.DataFrame(rows, columns=["folder", "path", "length", "mtime"]).astype({"length": "int64", "mtime": "float64"})


def walk_changed(spark: SparkSession, roots: list[str], before: str | None, after: str, stat_files: bool = True,
                 budget: int = 50_000, settled: float = SETTLED) -> DataFrame:
    """The inventory that ``walk`` gives, from the stored tree ``before`` (None:
    list everything), storing the tree ``after`` for the next time.

    Every stored folder is asked for its mark, and only new and changed ones
    are opened. With ``stat_files`` each known file is asked for its length and
    time; without, those of files in unchanged folders are as last listed.
    Folders outside ``roots`` leave the tree. A folder that can't be listed
    stops the walk with ``UnreadableFolder``; ``after`` must not exist."""
    roots = outermost(roots)
    for root in roots:
        require_root(root)
    asked = spark.createDataFrame([(r,) for r in roots], "folder string")
    files = same = known = None
    if before is not None:
        below = F.lit(False)
        for r in roots:
            below = below | (F.col("folder") == r) | F.col("folder").startswith(r.rstrip(os.sep) + os.sep)
        stored = spark.read.parquet(f"{before}/folders").where(below).select("folder", "mark")
        checked = stored.mapInPandas(_checker(roots), "folder string, mark string, state string").where("state <> 'gone'").checkpoint()
        known, same = checked.select("folder"), checked.where("state = 'same'").select("folder", "mark")
        files = spark.read.parquet(f"{before}/files").join(same.select("folder"), "folder", "left_semi").select("folder", "path", "length", "mtime")
        if stat_files:
            files = files.mapInPandas(_again, "folder string, path string, length long, mtime double")
        asked = checked.where("state = 'changed'").select("folder").unionByName(asked.join(known, "folder", "left_anti"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    opened, first = None, True
    while True:
        # known folders are checked on their own: the first round doesn't go down into them
        listed = asked.mapInPandas(_lister(0 if first else budget, settled), _LISTED).checkpoint()
        bad = [r["path"] for r in listed.where("kind = 'unreadable'").limit(20).collect()]
        if bad:
            raise UnreadableFolder(f"folders can't be listed, such as {'; '.join(bad)}")
        opened = listed if opened is None else opened.unionByName(listed)
        asked = listed.where("kind = 'dir'").select(F.col("path").alias("folder"))
        if first and known is not None:
            asked = asked.join(known, "folder", "left_anti")
        asked, first = asked.checkpoint(), False
        n = asked.count()
        if not n:
            break
        asked = asked.repartition(min(n, tasks))
    fresh = opened.where("kind = 'file'").select("folder", "path", "length", "mtime")
    (fresh if files is None else files.unionByName(fresh)).write.parquet(f"{after}/files")
    marks = opened.where("kind = 'folder'").select("folder", "mark", F.lit(True).alias("opened"))
    (marks if same is None else same.withColumn("opened", F.lit(False)).unionByName(marks)).write.parquet(f"{after}/folders")
    return spark.read.parquet(f"{after}/files").select(F.col("path").alias("origin_path"), "length", F.col("mtime").cast("timestamp").alias("mtime"))
