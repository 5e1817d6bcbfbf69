"""Reconcile the catalog with the files found on storage.

The reference compares two in-memory path lists with a nested linear search
and then issues one UPDATE per known path. Here both sides are DataFrames:
paths are pre-aggregated per side (duplicate catalog paths collapse map-side,
so a path shared by a third of the catalog is one row per task before the
shuffle) and meet in one hash-partitioned exchange keyed by the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.paths import basename
from cataloom.functions.times import run_time
from cataloom.operators.sequence import number_within
from cataloom.schema import conform, rejects, violations
from cataloom.sources.inventory import probe_missing


def _per_path(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per distinct path: catalog rows ``c`` and inventory rows ``i``. Both
    inputs share one exchange; duplicates collapse in the partial aggregate
    before it, so a path held by a third of the catalog costs one row per
    map task."""
    sides = (catalog.select(F.col("origin_path").alias("p"), F.lit(1).alias("c"), F.lit(0).alias("i"))
             .unionByName(inventory.select(F.col("origin_path").alias("p"), F.lit(0).alias("c"), F.lit(1).alias("i"))))
    return sides.groupBy("p").agg(F.sum("c").alias("c"), F.sum("i").alias("i"))


def reconcile(catalog: DataFrame, inventory: DataFrame, probe: bool = False) -> DataFrame:
    """One row per path of either side, computed once: catalog rows ``c``,
    inventory rows ``i``, and whether the path is ``present``. With ``probe``
    catalog paths that the inventory lacks (outside the walked roots, links,
    folders) are asked on the executors, once each."""
    known = _per_path(catalog, inventory).withColumn("present", F.when(F.col("i") > 0, F.lit(True)))
    # the probe's answers are written already
    known = probe_missing(known, "p", "present") if probe else known.checkpoint()
    return known.withColumn("present", F.coalesce("present", F.lit(False)))


def _new_paths(known: DataFrame, style: str) -> DataFrame:
    return (known.where((F.col("c") == 0) & (F.col("i") > 0))
            .select(F.col("p").alias("origin_path"), basename("p", style).alias("file_name")))


def new_files(inventory: DataFrame, catalog: DataFrame, style: str = "windows") -> DataFrame:
    """Files on storage that the catalog does not list (exact path match).
    Not an anti join: the optimizer drops a ``distinct`` under an anti join,
    and a hot catalog path would then reach one task with all its rows."""
    return _new_paths(_per_path(catalog, inventory), style)


def _flagged(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """``path_check`` from the per-path table. That table is a plain join
    side (written once, no aggregate above its exchange), so adaptive
    execution can split a path that very many catalog rows hold."""
    flags = known.where(F.col("c") > 0).select(F.col("p").alias("origin_path"), F.col("present").alias("_present"))
    joined = catalog.drop("path_check").join(flags, "origin_path", "left")
    return joined.withColumn("path_check", F.coalesce("_present", F.lit(False))).drop("_present").select(*catalog.columns)


def path_check(catalog: DataFrame, inventory: DataFrame, probe: bool = False) -> DataFrame:
    """Every catalog row with ``path_check`` recomputed."""
    return _flagged(catalog, reconcile(catalog, inventory, probe))


def sync_stats(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: files in the folder, new files, catalog size after the
    insert, and catalog rows whose file is gone.

    Both inputs go through one exchange: a union of (path, side) counted per
    path, with partial aggregation before the shuffle."""
    return _stats(_per_path(catalog, inventory).withColumn("present", F.col("i") > 0))


def _stats(known: DataFrame) -> DataFrame:
    """A path that two overlapping listings name is one new file."""
    new = F.coalesce(F.sum(F.when((F.col("c") == 0) & (F.col("i") > 0), 1)), F.lit(0))
    return known.agg(
        F.count_if(F.col("i") > 0).cast("long").alias("total_files_in_directory"),
        new.cast("long").alias("new_files_added"),
        (F.coalesce(F.sum("c"), F.lit(0)) + new).cast("long").alias("total_files_in_database"),
        F.coalesce(F.sum(F.when(~F.col("present"), F.col("c"))), F.lit(0)).cast("long").alias("missing_files"))


def missing_files(catalog: DataFrame) -> DataFrame:
    """Rows flagged as gone; a NULL flag is not counted."""
    return catalog.agg(F.count_if(F.col("path_check") == F.lit(False)).alias("missing_files"))


def _next(catalog: DataFrame, known: DataFrame, run_ts: str, style: str) -> tuple[DataFrame, DataFrame]:
    """(next catalog, refused files)."""
    ts = run_time(run_ts)
    updated = _flagged(conform(catalog, "file_list"), known).withColumn("updated_at", ts)
    found = _new_paths(known, style)
    fits = F.size(violations(found, "file_list")) == 0
    top = catalog.agg(F.max("id")).first()[0] or 0
    fresh = number_within(found.where(fits), [], ["origin_path"], "_n")
    fresh = (fresh.withColumn("id", (F.lit(top) + F.col("_n")).cast("int"))
                  .withColumn("created_at", ts)
                  .drop("_n"))
    return updated.unionByName(conform(fresh, "file_list")), rejects(found.where(~fits), "file_list", "origin_path")


def next_catalog(catalog: DataFrame, inventory: DataFrame, run_ts: str, style: str = "windows",
                 probe: bool = False) -> DataFrame:
    """The catalog after a sync, in the full table schema.

    Known rows get ``path_check`` = present and ``updated_at`` = run time
    (all of them, changed or not). New files are appended with ids after the
    current maximum, numbered in path order without a single-task window,
    ``created_at`` = run time and the column defaults (``path_check`` true);
    those that break a limit of the table are left out.
    """
    return _next(catalog, reconcile(catalog, inventory, probe), run_ts, style)[0]


def sync(catalog: DataFrame, inventory: DataFrame, run_ts: str, style: str = "windows",
         probe: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next catalog snapshot, run statistics and refused files (origin_path,
    reason), all from one per-path table. Refused files don't count as new."""
    known = reconcile(catalog, inventory, probe)
    nxt, refused = _next(catalog, known, run_ts, style)
    n = refused.agg(F.countDistinct("origin_path")).first()[0]
    stats = _stats(known)
    for column in ("new_files_added", "total_files_in_database"):
        stats = stats.withColumn(column, F.col(column) - F.lit(n))
    return nxt, stats, refused
