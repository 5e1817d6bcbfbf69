"""End-to-end catalog jobs: read the current snapshot, compute, touch the file
system on the executors where the job must, publish the next snapshot.

These are the bulk forms of the reference's endpoints (sync, convert, clear,
edit, image upload, gallery). Each returns the per-request outcome table.
"""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import changes as ch
from cataloom.operators import edits as ed
from cataloom.operators import images as im
from cataloom.operators import sync as sy
from cataloom.operators import transfer as tr
from cataloom.operators.joins import scratch_tables
from cataloom.session import ensure_checkpoint_dir
from cataloom.sources.changes import ChangedTable
from cataloom.sources.inventory import walk
from cataloom.sources.store import SnapshotConflict, SnapshotStore


def now_run_ts() -> str:
    """One time per run, UTC; tables store it rounded to whole seconds."""
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


@dataclass
class Catalog:
    """The two catalog tables as snapshot stores under one shared folder (that
    of the files with changes appended beside it), plus a folder for the
    written outcome tables of each run."""
    root: str

    @property
    def files(self) -> ChangedTable:
        return ChangedTable(os.path.join(self.root, "file_list"), "file_list")

    @property
    def images(self) -> SnapshotStore:
        return SnapshotStore(os.path.join(self.root, "file_image"), "file_image")

    @property
    def claims(self) -> SnapshotStore:
        return SnapshotStore(os.path.join(self.root, "image_claim"), "image_claim")

    def run_dir(self, kind: str, version: int | None) -> str:
        return os.path.join(self.root, "runs", f"{kind}-from-v{version}-{uuid.uuid4().hex[:12]}")


def _publish(spark: SparkSession, store: SnapshotStore, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Publish ``change`` of the current snapshot. When another writer was
    faster, the change is made again from the newer snapshot: ``change`` reads
    written outcomes only, so files already copied or moved are recorded."""
    for left in range(tries - 1, -1, -1):
        version = store.current()
        try:
            with scratch_tables(spark):
                return store.publish(change(store.read(spark, version)), version)
        except SnapshotConflict:
            if not left:
                raise
    raise AssertionError("unreachable")


def sync_job(spark: SparkSession, catalog: Catalog, roots: list[str], run_ts: str | None = None,
             style: str = "posix") -> dict:
    """Walk the folders, publish the reconciled catalog, return the stats.

    Catalogued files that the walk didn't list (other roots, links) are asked
    for on the executors. Files that break a limit of the table are reported
    under ``runs`` (origin_path, reason) and counted in ``refused_files``. A
    folder that can't be listed stops the job; nothing is published."""
    ensure_checkpoint_dir(spark)
    run_ts = run_ts or now_run_ts()
    version = catalog.files.current()
    current = catalog.files.read(spark, version)
    inventory = walk(spark, roots)
    nxt, stats, refused = sy.sync(current, inventory, run_ts, style, probe=True)
    report = catalog.run_dir("sync", version)
    refused.write.mode("errorifexists").parquet(report)
    out = stats.first().asDict()
    catalog.files.publish(nxt, version)
    return out | {"refused_files": spark.read.parquet(report).select("origin_path").distinct().count()}


def convert_job(spark: SparkSession, catalog: Catalog, requests: DataFrame, old_root: str, new_root: str,
                run_ts: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Copy the requested files to the parallel root and record the copies."""
    ensure_checkpoint_dir(spark)
    out_path = catalog.run_dir("convert", catalog.files.current())
    with scratch_tables(spark):
        plan = tr.convert_plan(requests, catalog.files.read(spark), existing, old_root, new_root, probe=True)
        tr.convert_execute(plan, out_path)
    return convert_record(spark, catalog, out_path, run_ts)


def convert_record(spark: SparkSession, catalog: Catalog, out_path: str, run_ts: str | None = None) -> DataFrame:
    """Record the written outcomes of a convert run, for instance of one that
    died after copying. Recording them twice changes nothing."""
    results, run = spark.read.parquet(out_path), os.path.basename(out_path)
    catalog.files.append(run, ch.copy_changes(results, run_ts or now_run_ts(), time.time_ns(), run))
    return results


def clear_job(spark: SparkSession, catalog: Catalog, requests: DataFrame, order: str = "req_id") -> DataFrame:
    """Delete the copies of the requested rows and clear their target paths."""
    ensure_checkpoint_dir(spark)
    out_path = catalog.run_dir("clear", catalog.files.current())
    with scratch_tables(spark):
        tr.clear_execute(tr.clear_plan(requests, catalog.files.read(spark), order), out_path)
    return clear_record(spark, catalog, out_path)


def clear_record(spark: SparkSession, catalog: Catalog, out_path: str) -> DataFrame:
    """Record the written outcomes of a clear run; a row that has another copy
    since then keeps it."""
    results, run = spark.read.parquet(out_path), os.path.basename(out_path)
    catalog.files.append(run, ch.clear_changes(results, time.time_ns(), run))
    return results


def edit_job(spark: SparkSession, catalog: Catalog, edits: DataFrame, run_ts: str | None = None) -> DataFrame:
    """Append a batch of edits; the report is written before. Both cost what
    the batch changes, not what the catalog holds."""
    ensure_checkpoint_dir(spark)
    run_ts = run_ts or now_run_ts()
    report_path = catalog.run_dir("edit", catalog.files.current())
    with scratch_tables(spark):
        current, run = catalog.files.read(spark), os.path.basename(report_path)
        ed.edit_report(current, edits).write.mode("errorifexists").parquet(report_path)
        catalog.files.append(run, ch.edit_changes(current, edits, run_ts, time.time_ns(), run))
    return spark.read.parquet(report_path)


def compact_job(spark: SparkSession, catalog: Catalog, tries: int = 5) -> int | None:
    """Publish the catalog with all appended changes folded in. Changes that
    are appended meanwhile stay beside the new snapshot."""
    ensure_checkpoint_dir(spark)
    for left in range(tries - 1, -1, -1):
        try:
            with scratch_tables(spark):
                return catalog.files.compact(spark)
        except SnapshotConflict:
            if not left:
                raise
    raise AssertionError("unreachable")


def image_job(spark: SparkSession, catalog: Catalog, uploads: DataFrame, public_root: str,
              run_ts: str | None = None) -> DataFrame:
    """Number the uploads, move their files into place, then append the rows
    of those that were placed or have no file. An upload without a parent id,
    or whose file is not there, takes no number and gets no row.

    Numbers are claimed in a published table before any file moves. Of two
    jobs that number at the same time, the later one to publish its claims
    numbers again, above those of the other. A move never replaces a file: where
    the name is taken after all, the upload stays where it is
    (``target_exists``) and its number unused, as after any failed move."""
    ensure_checkpoint_dir(spark)
    out_path, run = catalog.run_dir("image", catalog.images.current()), uuid.uuid4().hex
    with scratch_tables(spark):
        uploads = uploads.checkpoint()
        ready = im.placeable(uploads).checkpoint()
        # the claims are read before the image rows: a claim that is gone from the one is in the other
        version = _publish(spark, catalog.claims, lambda claims: im.claim_numbers(ready, catalog.images.read(spark), claims, run))
        assigned = im.claimed(ready, catalog.claims.read(spark, version), run).checkpoint()
        placed = im.image_place(assigned, ready, public_root, f"{out_path}-moves")
        status = im.upload_status(uploads, assigned).join(placed, "upload_id", "left")
        status.write.mode("errorifexists").parquet(out_path)
    return image_record(spark, catalog, out_path, run_ts)


def image_record(spark: SparkSession, catalog: Catalog, out_path: str, run_ts: str | None = None) -> DataFrame:
    """Append the rows of a written image run that the table lacks. A row and
    number belong to one upload of one run, which claimed them, so a run that is
    recorded twice adds nothing and no other run's row stands for its own."""
    results, run_ts = spark.read.parquet(out_path), run_ts or now_run_ts()
    done = results.where("outcome = 'placed' or status = 'no_file'")

    def change(images: DataFrame) -> DataFrame:
        there = images.select(F.col("file_list_id").alias("_row"), F.col("sort").alias("_sort"))
        fresh = done.join(there, (F.col("file_list_id") == F.col("_row")) & (F.col("sort") == F.col("_sort")), "left_anti")
        return im.image_commit(images, fresh, run_ts)

    _publish(spark, catalog.images, change)
    return results


def image_inventory(spark: SparkSession, public_root: str) -> DataFrame:
    """Stored image values of the files under the public folder."""
    root = os.path.normpath(public_root)
    files = walk(spark, [root])
    return files.select(F.expr(f"substring(origin_path, {len(root) + 1})").alias("image"))


def gallery_job(spark: SparkSession, catalog: Catalog, public_root: str, base_url: str,
                requests: DataFrame | None = None) -> DataFrame:
    """Images that exist, with their URLs (ordered by the caller). With
    ``requests`` (file_list_id) a status for each, and only the files of the
    requested rows are asked for; else the whole public folder is listed."""
    ensure_checkpoint_dir(spark)
    images = catalog.images.read(spark)
    if requests is not None:
        return im.gallery_for_ids(requests, images, None, base_url, public_root)
    return im.gallery(images, image_inventory(spark, public_root), base_url)
