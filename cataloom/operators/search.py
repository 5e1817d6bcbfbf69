"""Catalog search and the projections served to the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.text import INSENSITIVE, blank, contains_term
from cataloom.schema import all_of

SEARCH_FIELDS = ("name", "class", "prompt", "file_name")


def search(catalog: DataFrame, name: str | None = None, class_: str | None = None,
           prompt: str | None = None, file_name: str | None = None,
           collation: str = INSENSITIVE) -> DataFrame:
    """All catalog columns plus the constant ``img_exist`` = 1, for rows
    whose fields contain every non-blank term. A blank term adds nothing,
    yet the untrimmed term is what gets matched; ``%`` and ``_`` typed by
    the user stay wildcards. No terms: every row. No row cap, no order."""
    terms = {"name": name, "class": class_, "prompt": prompt, "file_name": file_name}
    conds = [contains_term(column, term, collation) for column, term in terms.items() if not blank(term)]
    return catalog.where(all_of(conds)).withColumn("img_exist", F.lit(1))


def display_rows(catalog: DataFrame) -> DataFrame:
    """The table shown on the page: NULL text becomes the empty string."""
    text = ["name", "class", "prompt", "origin_path", "target_path"]
    return catalog.select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text])


def scan_table(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """Dump a whole table of any schema: a catalog table name or a path."""
    if "/" in source or ":" in source:
        return spark.read.format(fmt).load(source)
    return spark.table(source)


def distinct_first(df: DataFrame, keys: list[str], order: str, out: str = "first_id") -> DataFrame:
    """Distinct keys, each with the position of its first occurrence (the
    order an ordered distinct keeps). Partial aggregation map-side."""
    return df.groupBy(*keys).agg(F.min(order).alias(out))


def as_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, one per row, the way the API answered: every
    column is there, NULL ones as ``null``."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))
