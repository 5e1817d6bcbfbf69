"""A small batch never shuffles the listing it is checked against."""

import re

from pyspark.sql import functions as F

from cataloom.operators import images as im
from cataloom.operators import transfer as tr
from cataloom.operators.joins import measured, only_keys
from plan_util import plan_text


def test_listing_is_cut_down_before_any_exchange(spark):
    listing = measured(spark.range(50_000).select(F.concat(F.lit("/old/"), F.col("id")).alias("path")))
    asked = spark.createDataFrame([("/old/7",), ("/old/7",), ("/gone",), (None,)], "path string")
    kept = only_keys(listing, asked, "path")
    assert "BroadcastHashJoin" in plan_text(kept) and not re.search(r"\bExchange\b", plan_text(kept))
    assert [r.path for r in kept.distinct().collect()] == ["/old/7"]


def test_plan_with_a_hot_and_a_null_path(spark):
    catalog = spark.createDataFrame([(i, "n", "/old/same" if i < 90 else None if i == 95 else f"/old/{i}") for i in range(1, 101)], "id int, name string, origin_path string")
    existing = spark.createDataFrame([("/old/same",), ("/old/91",), ("/new/91",), ("/old/91",), (None,)], "path string")
    requests = spark.createDataFrame([(k, k) for k in range(1, 101)] + [(101, None), (102, 500)], "req_id int, id int")
    got = {r.req_id: r.status for r in tr.convert_plan(requests, catalog, existing, "/old", "/new").collect()}
    assert got[1] == "converted" and all(got[k] == "target_exists" for k in (*range(2, 90), 91))
    assert got[90] == got[92] == "source_missing" and got[101] == "missing_id" and got[102] == "not_found"


def test_galleries_from_a_listing(spark):
    images = spark.createDataFrame([(1, 1, "/a", 1), (2, 1, "/b", 2), (3, 2, None, 1), (4, 3, "/a", 1)], "id int, file_list_id int, image string, sort int")
    listing = spark.createDataFrame([("/a",), ("/a",), ("/z",), (None,)], "image string")
    asked = spark.createDataFrame([(1,), (2,), (9,)], "file_list_id int")
    got = {r.file_list_id: (r.n_rows, r.n_present, r.status) for r in im.gallery_status(asked, images, listing).collect()}
    assert got == {1: (2, 1, "ok"), 2: (1, 0, "no_image_files"), 9: (0, 0, "no_image_rows")}
