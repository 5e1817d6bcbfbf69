"""Request files applied as they arrive, each file once.

Structured Streaming keeps which files of a folder belong to which batch. A
batch is a run with a name of its own; each of its steps writes one table and
is left out when that table is complete. A job that is run again does nothing
for files that it has seen, and one that died is taken up where it stopped:
the plan that it made is executed, not a plan that meets its own copies.

Files must be put into the folder whole (moved there) and not be changed.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import changes as ch
from cataloom.operators import edits as ed
from cataloom.operators import images as im
from cataloom.operators import transfer as tr
from cataloom.operators.joins import scratch_tables
from cataloom.operators.sequence import number_within
from cataloom.plans.jobs import Catalog, _publish, image_record, now_run_ts
from cataloom.session import ensure_checkpoint_dir
from cataloom.sources.requests import CORRUPT, stream_requests

_KEY = {"convert": "req_id", "clear": "req_id", "edit": "req_id", "image": "upload_id"}


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written if it isn't there yet; what a
    writer that died has left is replaced."""
    if not _complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _convert(spark: SparkSession, catalog: Catalog, run: str, at: str, requests: DataFrame, old_root: str, new_root: str) -> None:
    plan = _once(spark, f"{at}/plan", lambda: tr.convert_plan(requests, catalog.files.read(spark), None, old_root, new_root))
    token = hashlib.sha256(at.encode()).hexdigest()[:32]
    if _complete(spark, f"{at}/outcome"):
        tr.sweep_markers(spark.read.parquet(f"{at}/outcome"), token)
    else:
        tr.convert_execute(plan, f"{at}/outcome", token, "overwrite")
    catalog.files.append(run, ch.copy_changes(spark.read.parquet(f"{at}/outcome"), now_run_ts(), time.time_ns(), run))


def _clear(spark: SparkSession, catalog: Catalog, run: str, at: str, requests: DataFrame) -> None:
    """(A file that was deleted by a run that died is ``absent`` in the outcome.)"""
    plan = _once(spark, f"{at}/plan", lambda: tr.clear_plan(requests, catalog.files.read(spark)))
    if not _complete(spark, f"{at}/outcome"):
        tr.clear_execute(plan, f"{at}/outcome", "overwrite")
    catalog.files.append(run, ch.clear_changes(spark.read.parquet(f"{at}/outcome"), time.time_ns(), run))


def _edit(spark: SparkSession, catalog: Catalog, run: str, at: str, requests: DataFrame) -> None:
    _once(spark, f"{at}/outcome", lambda: ed.edit_report(catalog.files.read(spark), requests))
    catalog.files.append(run, ch.edit_changes(catalog.files.read(spark), requests, now_run_ts(), time.time_ns(), run))


def _image(spark: SparkSession, catalog: Catalog, run: str, at: str, requests: DataFrame, public_root: str) -> None:
    """No file moves before the claimed numbers are written here; a run that
    died before that claims others, and those that it claimed stay unused."""
    def claim() -> DataFrame:
        name = uuid.uuid4().hex
        version = _publish(spark, catalog.claims, lambda claims: im.claim_numbers(ready, catalog.images.read(spark), claims, name))
        return im.claimed(ready, catalog.claims.read(spark, version), name)

    ready = _once(spark, f"{at}/ready", lambda: im.placeable(requests))
    assigned = _once(spark, f"{at}/assigned", claim)
    if not _complete(spark, f"{at}/moves"):
        im.image_place(assigned, ready, public_root, f"{at}/moves", "overwrite")
    _once(spark, f"{at}/outcome", lambda: im.upload_status(requests, assigned).join(spark.read.parquet(f"{at}/moves"), "upload_id", "left"))
    image_record(spark, catalog, f"{at}/outcome")


_APPLY = {"convert": _convert, "clear": _clear, "edit": _edit, "image": _image}


def ingest_job(spark: SparkSession, catalog: Catalog, kind: str, folder: str, files_per_batch: int | None = None, **roots: str) -> list[str]:
    """Apply the request files of ``folder`` that no earlier call has applied
    and return the names of the runs made (or finished) for them.

    ``kind`` is convert (with ``old_root`` and ``new_root``), clear, edit or
    image (with ``public_root``). Within a batch, requests follow each other
    by the time and name of their file and the id that their sender gave
    (nulls first), and are numbered anew, as two files may use the same ids;
    ``outcomes`` tells both. Lines that don't parse are kept in the run's
    ``lines``. Of two calls for one folder at the same time Spark ends one."""
    ensure_checkpoint_dir(spark)
    key, runs = _KEY[kind], []
    stream = f"{kind}-{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:12]}"

    def apply(batch: DataFrame, number: int) -> None:
        run = f"{stream}-{number:09d}"
        at = f"{catalog.root}/runs/{run}"
        with scratch_tables(spark):
            lines = _once(spark, f"{at}/lines", lambda: batch)
            good = lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            requests = _once(spark, f"{at}/requests", lambda: number_within(good.withColumnRenamed(key, "given_id"), [], ["file_time", "file", "given_id"], key))
            _APPLY[kind](spark, catalog, run, at, requests.drop("given_id", "file", "file_time"), **roots)
        runs.append(run)

    query = (stream_requests(spark, folder, kind, files_per_batch).writeStream.foreachBatch(apply)
             .option("checkpointLocation", f"{catalog.root}/ingest/{stream}").trigger(availableNow=True).start())
    query.awaitTermination()
    return runs


def outcomes(spark: SparkSession, catalog: Catalog, runs: list[str], kind: str) -> DataFrame:
    """What became of the requests of ``runs``: run, file, given_id and the
    columns of the outcome (whose own key is the number within the run)."""
    out = None
    for run in runs:
        at = f"{catalog.root}/runs/{run}"
        given = spark.read.parquet(f"{at}/requests").select(_KEY[kind], "given_id", "file")
        rows = spark.read.parquet(f"{at}/outcome").join(given, _KEY[kind]).withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out
