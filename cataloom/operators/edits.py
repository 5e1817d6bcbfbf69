"""Bulk edits of the descriptive fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.times import run_time
from cataloom.operators.joins import lookup, measured, only_keys
from cataloom.schema import LENGTH_LIMITS

_LAST = "_last_edit"


def _breaks_limits():
    """Whether the table would refuse the fields of an edit request."""
    limits = LENGTH_LIMITS["file_list"]
    too_long = [F.length(c) > limits[t] for c, t in (("name", "name"), ("class_name", "class"), ("prompt", "prompt"))]
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), too_long), F.lit(False))


def last_edit_per_id(edits: DataFrame, order: str = "req_id") -> DataFrame:
    """The request that wins per id: the latest one that the table accepts,
    as separate calls applied in order would leave it. ``max_by`` aggregates
    partially before the shuffle, so an id edited a million times is still
    one row per task."""
    return (edits.where(F.col("id").isNotNull() & ~_breaks_limits())
                 .groupBy("id")
                 .agg(F.max_by(F.struct("name", "class_name", "prompt"), F.col(order)).alias(_LAST)))


def apply_edits(catalog: DataFrame, edits: DataFrame, run_ts: str, order: str = "req_id") -> DataFrame:
    """Overwrite name, class and prompt of every edited row (a missing field
    becomes NULL) and stamp ``updated_at``. Unknown ids and edits with values
    longer than the table takes change nothing."""
    last = measured(last_edit_per_id(edits, order))
    joined = catalog.join(last, "id", "left")
    hit = F.col(_LAST).isNotNull()
    changed = {
        "name": F.when(hit, F.col(f"{_LAST}.name")).otherwise(F.col("name")),
        "class": F.when(hit, F.col(f"{_LAST}.class_name")).otherwise(F.col("class")),
        "prompt": F.when(hit, F.col(f"{_LAST}.prompt")).otherwise(F.col("prompt")),
        "updated_at": F.when(hit, run_time(run_ts)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns])


def edit_report(catalog: DataFrame, edits: DataFrame, order: str = "req_id") -> DataFrame:
    """One status per edit request: ``missing_id``, ``not_found`` (the
    reference answers success for those too), ``rejected`` (a value longer
    than the table takes), ``applied`` (the winning edit of a known id) or
    ``superseded`` (a later edit of the same id wins)."""
    edits = edits.select(order, "id", _breaks_limits().alias("_refused"))
    last = measured(edits.where(F.col("id").isNotNull() & ~F.col("_refused")).groupBy("id").agg(F.max(order).alias("_win")))
    known = only_keys(catalog, edits, "id").select("id", F.lit(True).alias("_found"))
    r = lookup(lookup(edits, known, "id", order), last, "id", order)
    status = (F.when(F.col("id").isNull(), F.lit("missing_id"))
               .when(F.col("_found").isNull(), F.lit("not_found"))
               .when(F.col("_refused"), F.lit("rejected"))
               .when(F.col(order) == F.col("_win"), F.lit("applied"))
               .otherwise(F.lit("superseded")))
    return r.select(order, "id", status.alias("status"))
