"""Table schemas of the catalog, defaults and the schema-limit reject check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_LIST = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("class", T.StringType(), True),
    T.StructField("origin_path", T.StringType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("path_check", T.BooleanType(), True),
    T.StructField("target_path", T.StringType(), True),
    T.StructField("target_check", T.BooleanType(), True),
    T.StructField("image", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("deleted_at", T.TimestampType(), True),
])

FILE_IMAGE = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("file_list_id", T.IntegerType(), False),
    T.StructField("image", T.StringType(), True),
    T.StructField("sort", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("deleted_at", T.TimestampType(), True),
])

# Numbers that an image run has taken before it moves a file.
IMAGE_CLAIM = T.StructType([
    T.StructField("run", T.StringType(), False),
    T.StructField("upload_id", T.LongType(), True),
    T.StructField("file_list_id", T.IntegerType(), False),
    T.StructField("sort", T.IntegerType(), False),
])

# Fixed values of the catalog's storage definition: column defaults and the
# character limits of the text columns (NOT NULL columns have limit entries too).
DEFAULTS = {"file_list": {"path_check": True}, "file_image": {}}
LENGTH_LIMITS = {
    "file_list": {"name": 50, "prompt": 255, "class": 50, "origin_path": 255,
                  "file_name": 255, "target_path": 255, "image": 255},
    "file_image": {"image": 255},
}
NOT_NULL = {"file_list": ["id", "origin_path"], "file_image": ["id", "file_list_id"]}

SCHEMAS = {"file_list": FILE_LIST, "file_image": FILE_IMAGE, "image_claim": IMAGE_CLAIM}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the table schema: missing columns take their
    default (or NULL), present ones are cast, extra ones are dropped."""
    schema = SCHEMAS[table]
    defaults = DEFAULTS[table]
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def violations(df: DataFrame, table: str) -> Column:
    """Array of reasons a row breaks the table's limits (empty if none)."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}:null")) for c in NOT_NULL[table] if c in df.columns]
    checks += [F.when(F.length(c) > n, F.lit(f"{c}:length>{n}"))
               for c, n in LENGTH_LIMITS[table].items() if c in df.columns]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def rejects(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Rows that the reference's storage would refuse, one row per breach."""
    return (df.select(F.col(key), F.explode(violations(df, table)).alias("reason")))


def accepted(df: DataFrame, table: str) -> DataFrame:
    return df.where(F.size(violations(df, table)) == 0)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))
