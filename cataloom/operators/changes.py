"""Changes of catalog rows as rows of their own, folded in when the catalog is read.

A batch of edits, copies or clears is a table with one row for each id that it
changes; it costs what it changes. Folding takes the last change of each kind
by (at, run) with one partial aggregate, so an id changed a million times is
one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions.times import run_time
from cataloom.operators.edits import last_edit_per_id
from cataloom.operators.joins import measured, only_keys

EDIT = T.StructType([T.StructField("name", T.StringType()), T.StructField("class", T.StringType()), T.StructField("prompt", T.StringType())])
#: One of edit, copied (the path of a new copy) and cleared (the path whose copy
#: went) says what a row changes; updated_at is null where it is left alone.
CHANGE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("at", T.LongType()),
    T.StructField("run", T.StringType()),
    T.StructField("edit", EDIT),
    T.StructField("copied", T.StringType()),
    T.StructField("cleared", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])


def _rows(df: DataFrame, at: int, run: str, **said) -> DataFrame:
    given = {"at": F.lit(at), "run": F.lit(run), **said}
    return df.select(*[given.get(f.name, F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE.fields])


def edit_changes(catalog: DataFrame, edits: DataFrame, run_ts: str, at: int, run: str, order: str = "req_id") -> DataFrame:
    """The last accepted edit of each id that the catalog has: a later row
    of that id must not find an edit that was made before it."""
    last = measured(last_edit_per_id(edits, order))
    known = measured(only_keys(catalog, last, "id").select("id").distinct())
    fields = F.struct(F.col("_last_edit.name").alias("name"), F.col("_last_edit.class_name").alias("class"), F.col("_last_edit.prompt").alias("prompt"))
    return _rows(last.join(known, "id", "left_semi"), at, run, edit=fields, updated_at=run_time(run_ts))


def copy_changes(results: DataFrame, run_ts: str, at: int, run: str, outcome_col: str = "outcome") -> DataFrame:
    """The copies that were made (of several for an id, the smallest path)."""
    done = results.where(F.col(outcome_col) == "converted").groupBy("id").agg(F.min("new_path").alias("_path"))
    return _rows(done, at, run, copied=F.col("_path"), updated_at=run_time(run_ts))


def clear_changes(results: DataFrame, at: int, run: str) -> DataFrame:
    """The paths that were cleared; a row that has another copy by then keeps it."""
    done = results.where(F.col("status") == "cleared").groupBy("id").agg(F.min("target_path").alias("_path"))
    return _rows(done, at, run, cleared=F.col("_path"))


def fold(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog with all ``changes`` made, in the order of (at, run), as if
    each batch had rewritten it. Ids that the catalog lacks, and null ones,
    change nothing; rows that share an id change alike."""
    when = F.struct("at", "run")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), when))
    rows = changes.where(F.col("id").isNotNull())
    sets = measured(rows.where(F.col("cleared").isNull()).groupBy("id").agg(
        last("edit").alias("_edit"), last("copied").alias("_copied"), F.max(F.when(F.col("copied").isNotNull(), when)).alias("_copied_at"),
        last("updated_at").alias("_updated_at")))
    gone = measured(rows.where(F.col("cleared").isNotNull()).groupBy(F.col("id").alias("_gone_id"), F.col("cleared").alias("_gone"))
                    .agg(F.max(when).alias("_gone_at")))
    edited, target = F.col("_edit").isNotNull(), F.coalesce("_copied", "target_path")
    now = catalog.join(sets, "id", "left").withColumn("_target", target)
    now = now.join(gone, (F.col("id") == F.col("_gone_id")) & (F.col("_target") == F.col("_gone")), "left")
    cleared = F.col("_gone_at").isNotNull() & (F.col("_copied_at").isNull() | (F.col("_gone_at") > F.col("_copied_at")))
    made = {"target_path": F.when(~cleared, F.col("_target")), "updated_at": F.coalesce("_updated_at", "updated_at"),
            **{c: F.when(edited, F.col(f"_edit.{c}")).otherwise(F.col(c)) for c in ("name", "class", "prompt")}}
    return now.select(*[made[c].alias(c) if c in made else F.col(c) for c in catalog.columns])
