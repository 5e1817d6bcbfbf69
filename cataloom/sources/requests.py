"""Request tables: the bodies the reference received one HTTP call at a time,
read in bulk from JSON lines.

Every request kind has an explicit schema (no inference). Ids arrive as
strings from forms as often as numbers, so they are read as strings and
converted with ``try_cast``: a value that is not a number becomes NULL and
the job reports ``missing_id`` for it. Malformed lines are kept with their
raw text in ``_corrupt_record`` instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

_RAW = {
    "convert": [("req_id", T.LongType()), ("id", T.StringType())],
    "clear": [("req_id", T.LongType()), ("id", T.StringType())],
    "edit": [("req_id", T.LongType()), ("id", T.StringType()), ("name", T.StringType()),
             ("class_name", T.StringType()), ("prompt", T.StringType())],
    "image": [("upload_id", T.LongType()), ("file_list_id", T.StringType()), ("upload_path", T.StringType())],
}
_ID_COLUMNS = {"convert": ["id"], "clear": ["id"], "edit": ["id"], "image": ["file_list_id"]}


def raw_schema(kind: str) -> T.StructType:
    fields = [T.StructField(n, t, True) for n, t in _RAW[kind]]
    return T.StructType(fields + [T.StructField(CORRUPT, T.StringType(), True)])


def typed(df: DataFrame, kind: str, *more: str) -> DataFrame:
    """Convert id columns with ``try_cast`` (bad ids become NULL); ``more``
    names columns to keep besides."""
    cols = []
    for name, _ in _RAW[kind]:
        if name in _ID_COLUMNS[kind]:
            cols.append(F.expr(f"try_cast(trim({name}) as int)").alias(name))
        else:
            cols.append(F.col(name))
    if kind == "image":
        cols.append(F.col("upload_path").isNotNull().alias("has_file"))
    return df.select(*cols, CORRUPT, *more)


def read_requests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Requests of one kind from JSON lines under ``path``."""
    raw = (spark.read.schema(raw_schema(kind))
                .option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT)
                .json(path))
    return typed(raw, kind)


def stream_requests(spark: SparkSession, folder: str, kind: str, files_per_batch: int | None = None) -> DataFrame:
    """The same requests as a stream of the files that arrive in ``folder``,
    with ``file`` and ``file_time`` of each line."""
    reader = (spark.readStream.schema(raw_schema(kind)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.json(folder).withColumns({"file": F.col("_metadata.file_path"), "file_time": F.col("_metadata.file_modification_time")})
    return typed(raw, kind, "file", "file_time")


def valid(requests: DataFrame) -> DataFrame:
    return requests.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(requests: DataFrame) -> DataFrame:
    """Lines that did not parse, with their raw text (all columns are kept:
    Spark refuses a JSON scan that would read only the corrupt column)."""
    return requests.where(F.col(CORRUPT).isNotNull())
