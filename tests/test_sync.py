"""Sync invariants and the reference's quirks kept on purpose."""

from cataloom.operators.sync import new_files, next_catalog, path_check, sync, sync_stats
from cataloom.schema import FILE_LIST
from plan_util import plan_text

RUN = "2025-03-01 10:00:00"


def _catalog(spark, rows):
    full = [(i, None, None, None, p, p.split("\\")[-1], True, None, None, None, None, None, None) for i, p in rows]
    return spark.createDataFrame(full, FILE_LIST)


def _inv(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "origin_path string")


def test_stats_with_duplicate_catalog_paths(spark):
    cat = _catalog(spark, [(1, "D:\\a\\x"), (2, "D:\\a\\x"), (3, "D:\\a\\gone"), (9, "D:\\a\\y")])
    inv = _inv(spark, ["D:\\a\\x", "D:\\a\\y", "D:\\a\\new1", "D:\\a\\new2"])
    s = sync_stats(cat, inv).first().asDict()
    assert s == {"total_files_in_directory": 4, "new_files_added": 2, "total_files_in_database": 6,
                 "missing_files": 1}


def test_next_catalog_ids_and_flags(spark):
    cat = _catalog(spark, [(5, "D:\\a\\x"), (9, "D:\\a\\gone")])
    inv = _inv(spark, ["D:\\a\\x", "D:\\b\\z.png", "D:\\b\\a.png"])
    nxt = {r["origin_path"]: r for r in next_catalog(cat, inv, RUN).collect()}
    assert nxt["D:\\a\\gone"]["path_check"] is False
    assert nxt["D:\\a\\x"]["path_check"] is True
    # new rows: ids after the maximum, in path order, default flag, file name, created_at
    assert (nxt["D:\\b\\a.png"]["id"], nxt["D:\\b\\z.png"]["id"]) == (10, 11)
    assert nxt["D:\\b\\a.png"]["file_name"] == "a.png"
    assert nxt["D:\\b\\a.png"]["path_check"] is True
    assert nxt["D:\\b\\a.png"]["updated_at"] is None
    assert str(nxt["D:\\b\\a.png"]["created_at"]) == RUN
    # every known row is stamped, changed or not
    assert str(nxt["D:\\a\\x"]["updated_at"]) == RUN


def test_second_sync_adds_nothing(spark):
    cat = _catalog(spark, [(1, "D:\\a\\x")])
    inv = _inv(spark, ["D:\\a\\x", "D:\\a\\y", "D:\\a\\z"])
    first, stats1, _ = sync(cat, inv, RUN)
    first = first.checkpoint()
    second, stats2, _ = sync(first, inv, RUN)
    s1, s2 = stats1.first(), stats2.first()
    assert s1.new_files_added == 2 and s2.new_files_added == 0
    assert s2.total_files_in_database == first.count() == 3
    assert second.count() == 3 and s2.missing_files == 0


def test_path_match_is_exact(spark):
    cat = _catalog(spark, [(1, "D:\\A\\X.png")])
    inv = _inv(spark, ["D:\\a\\x.png"])
    assert new_files(inv, cat).count() == 1
    assert path_check(cat, inv).first()["path_check"] is False


def test_sync_stats_plan_has_one_exchange_by_path(spark):
    cat = _catalog(spark, [(1, "D:\\a\\x")])
    inv = _inv(spark, ["D:\\a\\x"])
    plan = plan_text(sync_stats(cat, inv))
    assert plan.count("hashpartitioning(p#") == 1
    assert "Join" not in plan


def test_files_that_break_a_limit_are_refused(spark):
    cat = _catalog(spark, [(1, "D:\\a\\x")])
    inv = _inv(spark, ["D:\\a\\x", "D:\\" + "y" * 300, "D:\\z"])
    nxt, stats, refused = sync(cat, inv, RUN)
    assert sorted(r.origin_path for r in nxt.collect()) == ["D:\\a\\x", "D:\\z"]
    assert {r.reason for r in refused.collect()} == {"origin_path:length>255", "file_name:length>255"}
    assert stats.first().asDict() == {"total_files_in_directory": 3, "new_files_added": 1, "total_files_in_database": 2, "missing_files": 0}


def test_a_path_named_twice_is_one_file(spark):
    s = sync_stats(_catalog(spark, []), _inv(spark, ["D:\\a\\x", "D:\\a\\x"])).first().asDict()
    assert (s["new_files_added"], s["total_files_in_database"]) == (1, 1)


def test_paths_outside_the_listing_are_asked_for(spark, tmp_path):
    there, gone = tmp_path / "other" / "a.png", tmp_path / "other" / "b.png"
    there.parent.mkdir()
    there.write_bytes(b"x")
    link = tmp_path / "link.png"
    link.symlink_to(there)
    cat = _catalog(spark, [(1, str(there)), (2, str(gone)), (3, str(link)), (4, str(there.parent))])
    inv = _inv(spark, ["/elsewhere/c.png"])
    assert {r.id: r.path_check for r in path_check(cat, inv, probe=True).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert {r.id: r.path_check for r in path_check(cat, inv).collect()} == {1: False, 2: False, 3: False, 4: False}
