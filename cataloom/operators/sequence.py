"""Dense 1-based numbering of rows inside groups, safe for hot groups.

``row_number().over(partitionBy(k).orderBy(o))`` sorts each whole group in
one task, so a key holding a third of all rows becomes one giant task. Here
the rows are range-partitioned on ``(keys, order)`` instead, which splits a
hot group over many partitions; each partition numbers its rows locally in
one streaming pass, and a group that continues from earlier partitions gets
the count of its rows there added. Only the first group of a partition can
continue from an earlier one, so that correction table has at most one row
per partition and is broadcast with a proven bound.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.session import ensure_checkpoint_dir, shuffle_partitions

_PID, _LOCAL, _N, _BEFORE = "_seq_pid", "_seq_local", "_seq_n", "_seq_before"
_RECORD_MASK = (1 << 33) - 1


def _same_as_previous(values: pd.Series, previous) -> np.ndarray:
    """Per row: is the value equal to the one before it (NULL equals NULL)?"""
    shifted = values.shift(1)
    if len(values):
        shifted.iloc[0] = previous
    both_null = values.isna().to_numpy() & shifted.isna().to_numpy()
    equal = (values == shifted).fillna(False).to_numpy(dtype=bool)
    return equal | both_null


def _local_numbers(keys: list[str], batches):
    """Number rows within runs of equal keys; the state crosses batch edges."""
    last_key: tuple | None = None
    last_n = 0
    for pdf in batches:
        if pdf.empty:
            yield pdf.assign(**{_LOCAL: pd.Series([], dtype="int64")})
            continue
        if keys:
            same = np.ones(len(pdf), dtype=bool)
            for i, k in enumerate(keys):
                prev = None if last_key is None else last_key[i]
                same &= _same_as_previous(pdf[k], prev)
            if last_key is None:
                same[0] = False
        else:
            same = np.ones(len(pdf), dtype=bool)
            same[0] = last_key is not None
        run_id = np.cumsum(~same)
        pos = np.arange(len(pdf))
        run_start = np.maximum.accumulate(np.where(~same, pos, 0))
        local = pos - run_start + 1
        # rows of the first run continue the previous batch's last run
        local = np.where(run_id == 0, local + last_n, local)
        last_n = int(local[-1])
        last_key = tuple(pdf[k].iloc[-1] for k in keys) if keys else ()
        yield pdf.assign(**{_LOCAL: local.astype("int64")})


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out`` = position of each row within its ``keys`` group in
    ``order`` (1-based, dense). ``(keys, order)`` should be unique so the
    numbering is deterministic. With no keys the whole table is one group."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sort_cols = [*keys, *order]
    staged = (df.repartitionByRange(shuffle_partitions(spark), *sort_cols)
                .sortWithinPartitions(*sort_cols)
                .withColumn(_PID, F.spark_partition_id()))
    if keys:
        schema = T.StructType(staged.schema.fields + [T.StructField(_LOCAL, T.LongType(), False)])
        numbered = staged.mapInPandas(partial(_local_numbers, keys), schema)
    else:
        # one group: the position inside the partition is the record number
        # that monotonically_increasing_id keeps in its lower 33 bits
        numbered = staged.withColumn(_LOCAL, F.monotonically_increasing_id().bitwiseAND(F.lit(_RECORD_MASK)) + 1)
    # checkpoint: the numbered rows are read twice below and must not be
    # recomputed with other range bounds; it also cuts the lineage
    local = numbered.checkpoint()

    per_part = local.groupBy(_PID, *keys).agg(F.max(_LOCAL).alias(_N))
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(_PID)
    carry = (per_part
             .withColumn(_BEFORE, F.sum(_N).over(window.rowsBetween(Window.unboundedPreceding, -1)))
             .where(F.col(_BEFORE) > 0)
             .select(F.col(_PID).alias("_c" + _PID), *[F.col(k).alias("_c_" + k) for k in keys], _BEFORE))
    cond = reduce(lambda a, b: a & b,
                  [F.col(_PID) == F.col("_c" + _PID)] + [F.col(k).eqNullSafe(F.col("_c_" + k)) for k in keys])
    joined = local.join(F.broadcast(carry), cond, "left")
    return (joined
            .withColumn(out, F.col(_LOCAL) + F.coalesce(F.col(_BEFORE), F.lit(0)))
            .drop(_PID, _LOCAL, _BEFORE, "_c" + _PID, *["_c_" + k for k in keys]))
