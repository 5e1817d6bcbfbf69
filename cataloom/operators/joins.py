"""Lookup joins that keep NULL keys from piling up in one task.

Request tables carry missing keys (no id sent, an id that did not parse, a
catalog row that was not found, so no path). A NULL key never matches, but a
hash exchange sends every NULL-key row to the same task. Here a NULL key is
replaced, for the join only, by a salted stand-in that cannot match any real
key and is spread by another column of the row: still one join, no second
pass over the input.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.session import ensure_checkpoint_dir

# Stand-ins: a string key gets a NUL-prefixed value (paths and names never
# contain NUL); a 32-bit key gets a 64-bit value above the 32-bit range.
_NUL = "\u0000"
_ABOVE_INT = 1 << 40
_SPREAD = 1 << 20
_SMALL_INTS = ("tinyint", "smallint", "int")

_LK, _RK = "_lookup_lk", "_lookup_rk"


def _keys(dtype: str, key: str, spread: str):
    if dtype in _SMALL_INTS:
        salt = F.lit(_ABOVE_INT) + F.pmod(F.xxhash64(F.col(spread)), F.lit(_SPREAD))
        return F.coalesce(F.col(key).cast("long"), salt), F.col(key).cast("long")
    as_text = F.col(key).cast("string")
    return F.coalesce(as_text, F.concat(F.lit(_NUL), F.col(spread).cast("string"))), as_text


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """``left LEFT JOIN right USING (key)``; rows of ``left`` with a NULL key
    are spread over tasks by ``spread`` and come back with ``right``'s
    columns NULL. ``right`` should hold each key at most once."""
    left_key, right_key = _keys(dict(left.dtypes)[key], key, spread)
    l = left.withColumn(_LK, left_key)
    r = right.select(right_key.alias(_RK), *[F.col(c) for c in right.columns if c != key])
    return l.join(r, F.col(_LK) == F.col(_RK), "left").drop(_LK, _RK)


_open_scopes: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables that ``measured`` writes inside are deleted at the end: for a
    job whose results are written tables of their own."""
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        # this scope itself: an outer one may list the same tables
        _open_scopes[:] = [scope for scope in _open_scopes if scope is not made]
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A new folder below the shared checkpoint folder, deleted with the
    tables of the job around it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    for made in _open_scopes:
        made.append(path)
    return path


def measured(df: DataFrame) -> DataFrame:
    """Write a request-sized table to the shared checkpoint folder and read
    it back. The planner then sizes it from its files: it is broadcast only
    when under ``spark.sql.autoBroadcastJoinThreshold``, and joined by
    shuffle beyond that, so a small batch never makes the catalog shuffle."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_keys(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``key`` occurs in ``keys`` (a semi join against
    the measured distinct keys): a request batch touches a few catalog rows,
    and only those go on to the joins with the requests."""
    wanted = measured(keys.select(key).where(F.col(key).isNotNull()).distinct())
    return big.join(wanted, key, "left_semi")
