"""Tables kept in the shared checkpoint folder, and input columns by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.session import ensure_checkpoint_dir


def few(df: DataFrame) -> DataFrame:
    """Four tasks a core at most: shuffle partitions are sized for texts and
    would give a table of numbers tiny tasks."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back:
    cuts the lineage, and lets the planner size the table from its files. A
    ``narrow`` table (numbers only) is made by few tasks."""
    spark = df.sparkSession
    if narrow:
        df = few(df)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(keys: DataFrame) -> DataFrame:
    """The side of a join with whole texts that has keys only: texts are dealt
    out by key and met by a hash table of the keys, at every size alike, and
    are not sorted."""
    return keys.hint("shuffle_hash")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string with null read as empty;
    every other column of ``docs`` is left behind unless named in ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])
