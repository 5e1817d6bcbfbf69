"""Bulk copy to a parallel root ("convert") and bulk removal of the copies
("clear"), each as plan -> execute -> commit.

* plan: a pure DataFrame, one status per request, checked by the oracle;
* execute: executors touch the file system for the rows the plan allows and
  report one outcome per row; the outcomes are written once to a table so a
  later action never repeats a file operation;
* commit: the next catalog snapshot from the written outcomes.
"""

from __future__ import annotations

import errno
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions.paths import replace_first
from cataloom.functions.times import run_time
from cataloom.operators.joins import lookup, measured, only_keys
from cataloom.schema import LENGTH_LIMITS
from cataloom.sources.inventory import probe_missing

_FOUND = "_found"


def _lookup(requests: DataFrame, catalog: DataFrame, cols: list[str], spread: str) -> DataFrame:
    """Requests joined to their catalog row by id (no row: not found)."""
    rows = only_keys(catalog, requests, "id").select("id", *cols, F.lit(True).alias(_FOUND))
    return lookup(requests, rows, "id", spread)


def _first_per(df: DataFrame, key: str, order: str, eligible) -> DataFrame:
    """Flag the first eligible request per key. ``min`` aggregates partially
    before the shuffle, and the flag is joined back on (key, order), which
    spreads a hot key's requests over tasks by their order value. The rows
    are materialised once (checkpoint) because both sides of that join read
    them; recomputing would repeat every join and probe above."""
    df = df.checkpoint()
    winners = (df.where(eligible).groupBy(key).agg(F.min(order).alias("_w_order"))
                 .withColumnRenamed(key, "_w_key").withColumn("_winner", F.lit(True)))
    cond = (F.col(key) == F.col("_w_key")) & (F.col(order) == F.col("_w_order"))
    return df.join(winners, cond, "left").drop("_w_key", "_w_order")


def convert_plan(requests: DataFrame, catalog: DataFrame, existing: DataFrame | None, old_root: str, new_root: str,
                 order: str = "req_id", probe: bool = False) -> DataFrame:
    """Status per copy request, in the reference's order of checks:
    ``missing_id`` (no id or 0), ``not_found`` (unknown id),
    ``target_exists`` (checked before the source; also every later request
    for a target an earlier request of the batch copies), ``source_missing``,
    ``rejected`` (the table can't hold the target's path), else ``converted``.
    The target is the path with the first occurrence of
    ``old_root`` replaced by ``new_root``.

    ``existing`` holds the paths known to exist (an inventory of both
    roots). With ``probe`` the paths it does not hold are asked on the
    executors, so folders, links and paths outside the roots answer too.
    Without ``existing`` every path of the batch is probed: the cost then
    follows the number of requested catalog rows, not the size of the trees."""
    # existence depends on the catalog row only: look it up once per
    # requested row (a few), not once per request (many), then join
    rows = only_keys(catalog, requests, "id").select("id", "name", "origin_path")
    rows = rows.withColumn("new_path", replace_first("origin_path", old_root, new_root))
    if existing is None:
        probe = True
        rows = rows.withColumn("_t", F.lit(None).cast("boolean")).withColumn("_s", F.lit(None).cast("boolean"))
    else:
        # of the listing, only the paths that the batch asks for are kept: a small
        # batch never shuffles it. Written once: a plain side of both joins, so that
        # adaptive execution can split a path that very many requested rows share
        rows = measured(rows)
        asked = rows.select(F.explode(F.array("new_path", "origin_path")).alias("path"))
        paths = measured(only_keys(existing.select("path"), asked, "path").distinct())
        rows = rows.join(paths.select(F.col("path").alias("new_path"), F.lit(True).alias("_t")), "new_path", "left")
        rows = rows.join(paths.select(F.col("path").alias("origin_path"), F.lit(True).alias("_s")), "origin_path", "left")
    if probe:
        rows = probe_missing(rows, "new_path", "_t")
        rows = probe_missing(rows, "origin_path", "_s")
    # measured: one row per requested catalog row, broadcast when small, so
    # the requests (a hot id among them) are never shuffled for this join
    rows = measured(rows.withColumn(_FOUND, F.lit(True)))
    r = lookup(requests, rows, "id", order)
    pre = (F.when(F.col("id").isNull() | (F.col("id") == 0), F.lit("missing_id"))
            .when(F.col(_FOUND).isNull(), F.lit("not_found"))
            .when(F.col("_t").isNotNull(), F.lit("target_exists"))
            .when(F.col("_s").isNull(), F.lit("source_missing"))
            .when(F.length("new_path") > LENGTH_LIMITS["file_list"]["target_path"], F.lit("rejected"))
            .otherwise(F.lit("ok")))
    r = _first_per(r.withColumn("_pre", pre), "new_path", order, F.col("_pre") == "ok")
    status = (F.when(F.col("_pre") != "ok", F.col("_pre"))
               .when(F.col("_winner").isNotNull(), F.lit("converted"))
               .otherwise(F.lit("target_exists")))
    return r.select(order, "id", status.alias("status"), "name", "origin_path", "new_path")


def clear_plan(requests: DataFrame, catalog: DataFrame, order: str = "req_id") -> DataFrame:
    """Status per clear request: ``missing_id``, ``not_found``,
    ``already_clear`` (target NULL or empty, the row stays as it is; also a
    later request, by the unique ``order``, for an id that an earlier one
    clears) or ``cleared``. ``new_target_path`` is the value after the
    request: NULL when cleared, else unchanged."""
    r = _lookup(requests, catalog, ["target_path"], order)
    pre = (F.when(F.col("id").isNull() | (F.col("id") == 0), F.lit("missing_id"))
            .when(F.col(_FOUND).isNull(), F.lit("not_found"))
            .when(F.coalesce(F.col("target_path"), F.lit("")) == "", F.lit("already_clear"))
            .otherwise(F.lit("cleared")))
    r = _first_per(r.withColumn("status", pre), "id", order, F.col("status") == "cleared")
    status = F.when((F.col("status") == "cleared") & F.col("_winner").isNull(), F.lit("already_clear")).otherwise(F.col("status"))
    new_target = F.when(status == "cleared", F.lit(None).cast("string")).otherwise(F.col("target_path"))
    return r.select(order, "id", status.alias("status"), "target_path", new_target.alias("new_target_path"))


# --------------------------------------------------------------------------
# execution on the executors

def _copy_errno(err: OSError) -> str:
    return {errno.ENOENT: "source_missing", errno.EACCES: "no_permission", errno.EPERM: "no_permission",
            errno.ENOSPC: "disk_full"}.get(err.errno, "failed")


def _own_copy(dst: str, *names: str) -> str | None:
    """The name under which this run made ``dst``, if it did."""
    return next((n for n in names if os.path.exists(n) and os.path.samefile(dst, n)), None)


def _copy_one(src: str, dst: str, token: str) -> tuple[str, str | None]:
    """Copy without ever overwriting: write a temp file next to the target,
    hard-link it into place (fails if the target appeared meanwhile) and keep
    the temp name as this run's marker. A retried task that finds the target
    to be this run's own file, under the marker's or still under the temp
    file's name, reports the copy again instead of a clash."""
    marker = f"{dst}.{token}.done"
    tmp = f"{dst}.{token}.part"
    try:
        if os.path.lexists(dst):
            own = _own_copy(dst, marker, tmp)
            if own is None:
                return "target_exists", None
            os.replace(own, marker)
            return "converted", "retry"
        os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
        shutil.copyfile(src, tmp)
        try:
            os.link(tmp, dst)
        except FileExistsError:
            os.unlink(tmp)
            return "target_exists", None
        os.replace(tmp, marker)
        return "converted", None
    except OSError as err:
        # a copy that failed half-way leaves no partial file behind
        if os.path.exists(tmp):
            os.unlink(tmp)
        return _copy_errno(err), str(err)


def _delete_one(path: str) -> tuple[str, str | None]:
    try:
        if not os.path.lexists(path):
            return "absent", None
        os.unlink(path)
        return "deleted", None
    except OSError as err:
        return "delete_failed", str(err)


def _sweep_one(dst: str, token: str) -> None:
    for end in ("done", "part"):
        try:
            os.unlink(f"{dst}.{token}.{end}")
        except FileNotFoundError:
            pass


def _execute(plan: DataFrame, allowed: str, action, cols: list[str], out_path: str, mode: str) -> DataFrame:
    """Run ``action`` on ``cols`` of the rows with status ``allowed`` and
    write every plan row with its ``outcome`` and ``detail`` to ``out_path``
    once; read that back. Each row carries its own outcome: no key is joined."""
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ["status", *cols]))
            done = [action(*values) if status == allowed else (None, None) for status, *values in rows]
            said = [pa.array([d[k] for d in done], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *said], names=[*batch.schema.names, "outcome", "detail"])

    spark = plan.sparkSession
    # one evaluation of the plan drives the file operations and the report
    plan = plan.checkpoint()
    schema = T.StructType([*plan.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("detail", T.StringType())])
    plan.mapInArrow(run, schema).write.mode(mode).parquet(out_path)
    return spark.read.parquet(out_path)


def sweep_markers(written: DataFrame, token: str) -> None:
    """Remove the retry markers of the run ``token``, whose outcomes are written."""
    def sweep(batches):
        for batch in batches:
            for dst in batch.column(0).to_pylist():
                _sweep_one(dst, token)
            yield batch

    tried = written.where(F.col("outcome").isNotNull()).select("new_path")
    tried.mapInArrow(sweep, tried.schema).write.format("noop").mode("overwrite").save()


def convert_execute(plan: DataFrame, out_path: str, token: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Copy the files of the ``converted`` rows; ``outcome`` is the copy's
    own result (``converted``, ``target_exists``, ``source_missing``,
    ``no_permission``, ``disk_full`` or ``failed``). Once the outcomes are
    written, the run's retry markers are removed. The same plan executed
    again under the ``token`` of a run that died knows that run's copies."""
    token = token or uuid.uuid4().hex
    written = _execute(plan, "converted", lambda src, dst: _copy_one(src, dst, token), ["origin_path", "new_path"], out_path, mode)
    sweep_markers(written, token)
    return written


def clear_execute(plan: DataFrame, out_path: str, mode: str = "errorifexists") -> DataFrame:
    """Delete the copies of the ``cleared`` rows: ``deleted``, ``absent`` or
    ``delete_failed`` (the row is cleared all the same, as in the reference)."""
    return _execute(plan, "cleared", _delete_one, ["target_path"], out_path, mode)


def convert_commit(catalog: DataFrame, results: DataFrame, run_ts: str, outcome_col: str = "status") -> DataFrame:
    """Catalog with ``target_path`` and ``updated_at`` set for every row whose
    copy was made; refused requests leave their row unchanged."""
    done = measured(results.where(F.col(outcome_col) == "converted")
                           .groupBy("id").agg(F.min("new_path").alias("_new_path")))
    joined = catalog.join(done, "id", "left")
    hit = F.col("_new_path").isNotNull()
    changed = {"target_path": F.when(hit, F.col("_new_path")).otherwise(F.col("target_path")),
               "updated_at": F.when(hit, run_time(run_ts)).otherwise(F.col("updated_at"))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns])


def clear_commit(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """Catalog with ``target_path`` NULL for every cleared id that still has
    the path that was cleared; ``updated_at`` is left alone, as the reference
    leaves it."""
    done = measured(plan.where(F.col("status") == "cleared").groupBy("id").agg(F.min("target_path").alias("_cleared")))
    joined = catalog.join(done, "id", "left")
    target = F.when(F.col("_cleared") == F.col("target_path"), F.lit(None).cast("string")).otherwise(F.col("target_path"))
    return joined.select(*[target.alias(c) if c == "target_path" else F.col(c) for c in catalog.columns])
