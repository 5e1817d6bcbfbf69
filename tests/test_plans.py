"""Plan shape of every registered query: no pair products, scans pruned."""

import pytest

import __spark_entry__ as entry
from cataloom.plans.catalog_queries import QUERIES
from plan_util import plan_text

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_products(spark, sf_dir, name):
    plan = plan_text(entry.queries()[name](spark, sf_dir))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


def test_binary_search_pushes_filter_and_prunes(spark, sf_dir):
    plan = plan_text(entry.queries()["catalog_search"](spark, sf_dir))
    assert "StringContains(lang,e)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


def test_stats_reads_two_columns(spark, sf_dir):
    plan = plan_text(entry.queries()["sync_stats"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "text" not in plan


def test_small_edit_batch_does_not_shuffle_the_catalog(spark, sf_dir):
    plan = plan_text(entry.queries()["apply_edits"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_requests_only_touch_requested_catalog_rows(spark, sf_dir):
    from cataloom.operators.transfer import _lookup
    from cataloom.sources import fixtures as fx

    plan = plan_text(_lookup(fx.fx_clear_requests(spark, sf_dir), fx.fx_file_list(spark, sf_dir), ["target_path"], "req_id"))
    assert "LeftSemi" in plan


def test_sync_shuffles_each_side_by_path_once(spark, sf_dir):
    """The per-path table is made by one exchange; the flags join it back."""
    from cataloom.operators.sync import _per_path, reconcile
    from cataloom.sources import fixtures as fx

    catalog, inventory = fx.fx_file_list(spark, sf_dir), fx.fx_inventory(spark, sf_dir)
    assert plan_text(_per_path(catalog, inventory)).count("hashpartitioning(p#") == 1
    joined = plan_text(entry.queries()["sync_path_check"](spark, sf_dir))
    assert "Aggregate" not in joined  # a plain side, which a skew join can split
    assert "Aggregate" not in plan_text(reconcile(catalog, inventory))


def test_hot_sides_are_plain(spark, sf_dir):
    assert "Aggregate" not in plan_text(entry.queries()["image_gallery"](spark, sf_dir))


def test_requested_ids_grow_with_the_tables(spark, sf_dir):
    from cataloom.sources import fixtures as fx

    for view, column in ((fx.fx_convert_requests, "id"), (fx.fx_edits, "id"), (fx.fx_uploads, "file_list_id")):
        small, large = (view(spark, sf_dir.replace("0.001", sf)).select(column).distinct().count() for sf in ("0.01", "0.1"))
        assert large > 7 * small, view.__name__
