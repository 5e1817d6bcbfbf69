"""Image numbering, image rows, galleries."""

from __future__ import annotations

import errno
import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions.paths import image_path, path_join, static_url
from cataloom.functions.times import run_time
from cataloom.operators.joins import lookup, measured, only_keys
from cataloom.operators.sequence import number_within
from cataloom.schema import conform
from cataloom.sources.inventory import probe_missing


def max_sort(images: DataFrame) -> DataFrame:
    """Highest sort number per catalog row (NULL for a group of NULLs)."""
    return images.groupBy("file_list_id").agg(F.max("sort").alias("_max_sort"))


def image_assign(uploads: DataFrame, images: DataFrame, key: str = "upload_id") -> DataFrame:
    """Sort number and stored name for every upload of a batch that has a
    parent id; the others take no number.

    One upload gets ``max(sort) + 1`` of its row (1 when the row has no
    image, or only NULL or 0 sorts); several uploads for one row in a batch
    are numbered on in upload order, as sequential calls would. Uploads
    without a file still take a number, with a NULL image."""
    numbered = number_within(uploads.where(F.col("file_list_id").isNotNull()), ["file_list_id"], [key], "_rn")
    # only the image rows of the uploaded-to catalog rows are aggregated
    touched = only_keys(images, uploads, "file_list_id")
    joined = lookup(numbered, measured(max_sort(touched)), "file_list_id", key)
    sort = (F.coalesce(F.col("_max_sort"), F.lit(0)) + F.col("_rn")).cast("int")
    return (joined.withColumn("sort", sort)
                  .select(key, "file_list_id", "sort",
                          F.when(F.col("has_file"), image_path("file_list_id", "sort")).alias("image")))


def upload_status(uploads: DataFrame, assigned: DataFrame, key: str = "upload_id") -> DataFrame:
    """Per upload: ``missing_id`` (no parent id, or one that isn't a number:
    no number, no file, no row), ``no_file`` or ``numbered``."""
    named = assigned.select(F.col(key).alias("_key"), "sort", "image", F.lit(True).alias("_assigned"))
    status = (F.when(F.col("file_list_id").isNull(), F.lit("missing_id"))
               .when(F.col("_assigned").isNull(), F.lit("upload_missing"))
               .when(F.col("image").isNull(), F.lit("no_file"))
               .otherwise(F.lit("numbered")))
    return uploads.join(named, F.col(key) == F.col("_key"), "left").select(key, "file_list_id", status.alias("status"), "sort", "image")


def _seen(pdf: pd.DataFrame) -> pd.Series:
    """Who the file at ``upload_path`` is, as ``_identity`` tells; None without one."""
    return pd.Series([None if p is None or not has else _identity(p) for p, has in zip(pdf["upload_path"], pdf["has_file"])], dtype=object)


def _identity(path: str) -> str | None:
    """Size and time of change in nanoseconds: what a move keeps, also one to
    another file system, and no other file shares."""
    try:
        st = os.stat(path)
    except OSError:
        return None
    return f"{st.st_size}:{st.st_mtime_ns}"


def placeable(uploads: DataFrame) -> DataFrame:
    """Uploads that have no file, or one that is there (with its ``identity``):
    a missing file fails its upload before it takes a number, as a failed
    move did."""
    schema = T.StructType(uploads.schema.fields + [T.StructField("identity", T.StringType())])
    asked = uploads.mapInPandas(lambda batches: (pdf.assign(identity=_seen(pdf)) for pdf in batches), schema)
    return asked.where(~F.col("has_file") | F.col("identity").isNotNull())


def claim_numbers(ready: DataFrame, images: DataFrame, claims: DataFrame, run: str) -> DataFrame:
    """The next table of claims (run, upload_id, file_list_id, sort): those
    that the image rows don't show yet, and one for each upload of ``run``,
    above every number that an image row or a claim of its catalog row has."""
    shown = images.groupBy(F.col("file_list_id").alias("_row")).agg(F.max("sort").alias("_shown"))
    open_ = (lookup(claims, shown.withColumnRenamed("_row", "file_list_id"), "file_list_id", "upload_id")
             .where(F.col("_shown").isNull() | (F.col("sort") > F.col("_shown"))).select("run", "upload_id", "file_list_id", "sort"))
    taken = images.select("file_list_id", "sort").unionByName(claims.select("file_list_id", "sort"))
    own = image_assign(ready, taken).select(F.lit(run).alias("run"), F.col("upload_id").cast("long").alias("upload_id"), "file_list_id", "sort")
    return open_.unionByName(own)


def claimed(uploads: DataFrame, claims: DataFrame, run: str) -> DataFrame:
    """(upload_id, file_list_id, sort, image) of the uploads of ``run``, by its published claims."""
    mine = claims.where(F.col("run") == run).select(F.col("upload_id").alias("_id"), "sort")
    joined = uploads.select("upload_id", "file_list_id", "has_file").join(mine, F.col("upload_id") == F.col("_id"))
    return joined.select("upload_id", "file_list_id", "sort", F.when(F.col("has_file"), image_path("file_list_id", "sort")).alias("image"))


_PLACED = T.StructType([T.StructField("upload_id", T.LongType()), T.StructField("outcome", T.StringType()),
                        T.StructField("detail", T.StringType())])


def _place(src: str, dest: str, identity: str) -> tuple[str, str | None]:
    """Move a file to a name that must be free. The name comes into being as a
    link of the whole file, in one step that fails if it is there."""
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    if not os.path.lexists(src):
        # a retried task finds its file already moved
        return ("placed", "retry") if _identity(dest) == identity else ("upload_missing", "the file has gone")
    whole, copied = src, None
    try:
        try:
            os.link(src, dest)
        except OSError as err:
            if err.errno != errno.EXDEV:
                raise
            copied = whole = f"{dest}.{uuid.uuid4().hex}.part"
            shutil.copy2(src, whole)
            os.link(whole, dest)
    except FileExistsError:
        if _identity(dest) != identity:
            return "target_exists", None
    finally:
        if copied and os.path.exists(copied):
            os.unlink(copied)
    os.unlink(src)
    return "placed", None


def _mover(public_root: str):
    def run(batches):
        for pdf in batches:
            out = []
            for src, image, identity in zip(pdf["upload_path"], pdf["image"], pdf["identity"]):
                try:
                    out.append(_place(src, os.path.join(public_root, image.lstrip("/")), identity))
                except OSError as err:
                    out.append(("failed", str(err)))
            yield pd.DataFrame({"upload_id": pdf["upload_id"].astype("int64"),
                                "outcome": [o[0] for o in out], "detail": [o[1] for o in out]})
    return run


def image_place(assigned: DataFrame, uploads: DataFrame, public_root: str, out_path: str, mode: str = "errorifexists") -> DataFrame:
    """Move every uploaded file (``placeable``) to its numbered name under
    ``public_root`` and write one outcome per upload once; uploads without a
    file are skipped. A file that has the name already stays, and the
    upload with it (``target_exists``)."""
    spark = assigned.sparkSession
    todo = (assigned.where(F.col("image").isNotNull())
                    .join(uploads.select("upload_id", "upload_path", "identity"), "upload_id")
                    .checkpoint())
    todo.select(F.col("upload_id").cast("long"), "upload_path", "identity", "image") \
        .mapInPandas(_mover(public_root), _PLACED) \
        .write.mode(mode).parquet(out_path)
    return spark.read.parquet(out_path)


def image_commit(images: DataFrame, assigned: DataFrame, run_ts: str, key: str = "upload_id") -> DataFrame:
    """The image table with the assigned uploads appended (ids after the
    current maximum, in upload order)."""
    top = images.agg(F.max("id")).first()[0] or 0
    ts = run_time(run_ts)
    fresh = (number_within(assigned, [], [key], "_n")
             .withColumn("id", (F.lit(top) + F.col("_n")).cast("int"))
             .withColumn("created_at", ts)
             .withColumn("updated_at", ts))
    return conform(images, "file_image").unionByName(conform(fresh, "file_image"))


def _urls(base_url: str):
    return static_url("image").alias("image_url"), static_url("image", base_url).alias("full_url")


def gallery(images: DataFrame, image_inventory: DataFrame, base_url: str) -> DataFrame:
    """Images whose file exists, with the page URL and the absolute URL.
    Rows with a NULL image drop out (they never match)."""
    # a semi join needs no distinct, and a plain side lets a hot image split
    return (images.join(image_inventory.select("image"), "image", "left_semi")
                  .select("file_list_id", "sort", "image", *_urls(base_url)))


def _asked_images(requests: DataFrame, images: DataFrame, image_inventory: DataFrame | None,
                  public_root: str | None) -> DataFrame:
    """Image rows of the requested catalog rows, with ``_present``: from the
    listing, or asked of the file system for these rows alone."""
    mine = only_keys(images, requests, "file_list_id")
    if image_inventory is not None:
        # of the listing, only the images of the requested rows are kept; written
        # once: a plain side of the join, which can split a hot image
        mine = measured(mine)
        present = measured(only_keys(image_inventory.select("image"), mine, "image").distinct().withColumn("_present", F.lit(True)))
        # image rows without a file (NULL image) are spread by their row id
        return lookup(mine, present, "image", "id")
    paths = mine.withColumn("_present", F.lit(None).cast("boolean")).withColumn(
        "_path", F.when(F.col("image").isNotNull(), path_join(F.lit(public_root), "image", style="posix")))
    return probe_missing(paths, "_path", "_present").drop("_path")


def _status(n_rows, n_present):
    return (F.when(n_rows == 0, F.lit("no_image_rows"))
             .when(n_present == 0, F.lit("no_image_files"))
             .otherwise(F.lit("ok")))


def gallery_status(requests: DataFrame, images: DataFrame, image_inventory: DataFrame | None,
                   public_root: str | None = None) -> DataFrame:
    """Per requested catalog row: how many image rows it has, how many of
    them exist, and the outcome (``no_image_rows``, ``no_image_files`` or
    ``ok``). Counts only, so a row with millions of images stays cheap; the
    image list itself is ``gallery_for_ids``, ordered by the caller."""
    per_row = (_asked_images(requests, images, image_inventory, public_root)
               .groupBy(F.col("file_list_id").alias("_row"))
               .agg(F.count(F.lit(1)).alias("n_rows"), F.count("_present").alias("n_present")))
    asked = requests.select("file_list_id").distinct()
    out = asked.join(per_row, F.col("file_list_id") == F.col("_row"), "left")
    n_rows = F.coalesce(F.col("n_rows"), F.lit(0))
    n_present = F.coalesce(F.col("n_present"), F.lit(0))
    return out.select("file_list_id", n_rows.alias("n_rows"), n_present.alias("n_present"), _status(n_rows, n_present).alias("status"))


def gallery_for_ids(requests: DataFrame, images: DataFrame, image_inventory: DataFrame | None, base_url: str,
                    public_root: str | None = None) -> DataFrame:
    """The galleries of the requested catalog rows: one row for each existing
    image of an ``ok`` row, and one without an image for the others. Without
    a listing, only the files of the requested rows are asked for."""
    mine = _asked_images(requests, images, image_inventory, public_root).checkpoint()
    per_row = measured(mine.groupBy(F.col("file_list_id").alias("_row"))
                       .agg(F.count(F.lit(1)).alias("n_rows"), F.count("_present").alias("n_present")))
    asked = requests.select("file_list_id").distinct().join(per_row, F.col("file_list_id") == F.col("_row"), "left")
    none = F.lit(None).cast("string")
    empty = (asked.where(F.coalesce("n_present", F.lit(0)) == 0)
             .select("file_list_id", _status(F.coalesce("n_rows", F.lit(0)), F.lit(0)).alias("status"),
                     F.lit(None).cast("int").alias("sort"), none.alias("image"), none.alias("image_url"), none.alias("full_url")))
    shown = mine.where("_present").select("file_list_id", F.lit("ok").alias("status"), "sort", "image", *_urls(base_url))
    return shown.unionByName(empty)


def catalog_images(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """Catalog rows with their image count and highest sort number; the
    image side is aggregated per row before it meets the catalog."""
    per_row = images.groupBy("file_list_id").agg(F.count("image").alias("n_images"), F.max("sort").alias("max_sort"))
    joined = catalog.select("id", "file_name").join(per_row, catalog["id"] == per_row["file_list_id"], "left")
    return joined.select("id", "file_name",
                         F.coalesce(F.col("n_images"), F.lit(0)).alias("n_images"), "max_sort")
