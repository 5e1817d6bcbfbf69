"""Walk, probe, copy, delete and snapshots on a throw-away tree."""

import os

import pytest
from pyspark.sql import functions as F

from cataloom.operators.transfer import (clear_commit, clear_execute, clear_plan, convert_commit, convert_execute,
                                         convert_plan)
from cataloom.schema import FILE_LIST
from cataloom.operators import transfer
from cataloom.sources import inventory
from cataloom.sources.inventory import UnreadableFolder, outermost, probe_missing, require_root, walk
from cataloom.sources.store import SnapshotConflict, SnapshotStore


def _write(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "file_path"
    for rel in ["x.png", "a/1.txt", "a/b/1.txt", "_d/in.txt"]:
        _write(str(root / rel), b"data-" + rel.encode())
    _write(str(root / "c/empty.png"), b"")
    _write(str(root / "c/_hidden.txt"))
    _write(str(root / "c/.dot"))
    os.symlink(str(root / "x.png"), str(root / "c/link.png"))
    os.makedirs(str(root / "emptydir"))
    return str(root)


def _expected(root):
    rels = ["x.png", "a/1.txt", "a/b/1.txt", "_d/in.txt", "c/empty.png", "c/_hidden.txt", "c/.dot"]
    return sorted(os.path.join(root, r) for r in rels)


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_walk_lists_regular_files_only(spark, tree, budget):
    inv = walk(spark, [tree, tree + "/", os.path.join(tree, "a")], budget=budget)
    got = sorted(r.origin_path for r in inv.collect())
    assert got == _expected(tree)
    sizes = {r.origin_path: r.length for r in inv.collect()}
    assert sizes[os.path.join(tree, "c/empty.png")] == 0


def test_missing_root_stops_before_any_job(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        require_root(str(tmp_path / "nope"))
    with pytest.raises(FileNotFoundError):
        walk(spark, [str(tmp_path / "nope")])


def test_probe_only_answers_unmatched_rows(spark, tree):
    df = spark.createDataFrame([(os.path.join(tree, "a"), None), (os.path.join(tree, "nope"), None),
                                ("/definitely/not/here", True)], "p string, f boolean")
    got = {r.p: r.f for r in probe_missing(df, "p", "f").collect()}
    assert got[os.path.join(tree, "a")] is True
    assert got[os.path.join(tree, "nope")] is None
    assert got["/definitely/not/here"] is True


def _catalog(spark, root, names, targets=None):
    targets = targets or {}
    rows = [(i + 1, None, None, None, os.path.join(root, n), os.path.basename(n), True, targets.get(i + 1),
             None, None, None, None, None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, FILE_LIST)


def test_convert_execute_and_commit(spark, tree, tmp_path):
    new_root = tree.replace("file_path", "file_new_path")
    cat = _catalog(spark, tree, ["x.png", "a/1.txt", "a/b/1.txt", "gone.png"])
    _write(os.path.join(new_root, "a/1.txt"), b"already there")
    existing = walk(spark, [tree, new_root]).select(F.col("origin_path").alias("path"))
    reqs = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, None), (7, 99)], "req_id int, id int")
    plan = convert_plan(reqs, cat, existing, tree, new_root, probe=True)
    status = {r.req_id: r.status for r in plan.collect()}
    assert status == {1: "converted", 2: "target_exists", 3: "target_exists", 4: "converted",
                      5: "source_missing", 6: "missing_id", 7: "not_found"}
    out = str(tmp_path / "runs" / "convert1")
    res = convert_execute(plan, out)
    outcome = {r.req_id: r.outcome for r in res.collect()}
    assert outcome[1] == "converted" and outcome[4] == "converted" and outcome[2] is None
    with open(os.path.join(new_root, "x.png"), "rb") as f:
        assert f.read() == b"data-x.png"
    assert not [n for n in os.listdir(new_root) if n.endswith(".done") or n.endswith(".part")]
    # executing the same plan again copies nothing and overwrites nothing:
    # each copy task checks its target itself
    again = {r.req_id: r.outcome for r in convert_execute(plan, str(tmp_path / "runs" / "convert2")).collect()}
    assert again[1] == "target_exists" and again[4] == "target_exists"
    # a plan built afresh sees the copies through the probe
    fresh = convert_plan(reqs, cat, existing, tree, new_root, probe=True)
    assert {r.req_id: r.status for r in fresh.collect()}[1] == "target_exists"
    with open(os.path.join(new_root, "a/1.txt"), "rb") as f:
        assert f.read() == b"already there"
    nxt = {r.id: r for r in convert_commit(cat, res, "2025-01-02 00:00:00", outcome_col="outcome").collect()}
    assert nxt[1].target_path == os.path.join(new_root, "x.png")
    assert nxt[2].target_path is None and nxt[2].updated_at is None
    assert nxt[3].target_path == os.path.join(new_root, "a/b/1.txt")


def test_clear_execute_and_commit(spark, tree, tmp_path):
    copy = os.path.join(str(tmp_path), "copy.png")
    _write(copy)
    cat = _catalog(spark, tree, ["x.png", "a/1.txt", "a/b/1.txt"],
                   {1: copy, 2: "", 3: os.path.join(str(tmp_path), "never-made.png")})
    reqs = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 42)], "req_id int, id int")
    plan = clear_plan(reqs, cat, order="req_id")
    status = {r.req_id: r.status for r in plan.collect()}
    assert status == {1: "cleared", 2: "already_clear", 3: "already_clear", 4: "cleared", 5: "not_found"}
    res = {r.req_id: r.outcome for r in clear_execute(plan, str(tmp_path / "runs" / "clear")).collect()}
    assert res[1] == "deleted" and res[4] == "absent"
    assert not os.path.exists(copy)
    nxt = {r.id: r.target_path for r in clear_commit(cat, plan).collect()}
    assert nxt == {1: None, 2: "", 3: None}


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "catalog"))
    assert store.current() is None and store.read(spark).count() == 0
    cat = _catalog(spark, "/r", ["a", "b"])
    v0 = store.publish(cat, None)
    assert v0 == 0 and store.read(spark).count() == 2
    v1 = store.publish(store.read(spark).where("id = 1"), v0)
    assert v1 == 1 and store.read(spark).count() == 1 and store.read(spark, 0).count() == 2
    with pytest.raises(SnapshotConflict):
        store.publish(cat, v0)


def test_of_two_writers_one_publishes(spark, tmp_path, monkeypatch):
    store = SnapshotStore(str(tmp_path / "catalog"))
    cat = _catalog(spark, "/r", ["a", "b"])
    v0 = store.publish(cat, None)
    # both saw v0 as current; the other one was first to claim the version
    assert store._claim(v0 + 1, "data/of-the-other")
    monkeypatch.setattr(store, "current", lambda: v0)
    with pytest.raises(SnapshotConflict):
        store.publish(cat, v0)
    assert [n for n in os.listdir(tmp_path / "catalog" / "versions") if "json" in n and not n.endswith(".crc")] and len(os.listdir(tmp_path / "catalog" / "data")) == 1


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "catalog"))
    cat = _catalog(spark, "/r", ["a", "b"])
    cat.write.parquet(str(tmp_path / "catalog" / "data" / "000000-left-behind"))
    assert store.publish(cat, None) == 0 and store.read(spark).count() == 2


def test_copy_errors_map_to_statuses(spark, tree, tmp_path):
    new_root = tree.replace("file_path", "file_new_path")
    cat = _catalog(spark, tree, ["x.png", "a/1.txt"])
    reqs = spark.createDataFrame([(1, 1), (2, 2)], "req_id int, id int")
    existing = walk(spark, [tree]).select(F.col("origin_path").alias("path"))
    plan = convert_plan(reqs, cat, existing, tree, new_root).checkpoint()
    assert {r.req_id: r.status for r in plan.collect()} == {1: "converted", 2: "converted"}
    # the source disappears between planning and copying
    os.unlink(os.path.join(tree, "a/1.txt"))
    res = {r.req_id: (r.outcome, r.detail is not None)
           for r in convert_execute(plan, str(tmp_path / "runs" / "c")).collect()}
    assert res == {1: ("converted", False), 2: ("source_missing", True)}
    assert not os.path.exists(os.path.join(new_root, "a/1.txt"))


def test_outermost_roots():
    assert outermost(["/a/b", "/a", "/ab", "/a/", "/c/d/../e"]) == ["/a", "/ab", "/c/e"]


def test_an_unreadable_folder_stops_the_walk(spark, tree, monkeypatch):
    """(Run as root, a mode can't close a folder: the walker is given a path
    that can't be listed.)"""
    run = inventory._walker(100)
    monkeypatch.setattr(inventory, "_walker", lambda budget: lambda batches: (
        f for b in batches for f in run([b.assign(path=b["path"] + "/x.png")])))
    with pytest.raises(UnreadableFolder, match="x.png"):
        walk(spark, [tree])


def test_a_vanished_file_is_left_out_alone(tmp_path, monkeypatch):
    for i in range(10):
        _write(str(tmp_path / f"{i}.png"))

    class Entry:
        def __init__(self, e):
            self.e, self.path = e, e.path

        def is_dir(self, **kw):
            return self.e.is_dir(**kw)

        def is_file(self, **kw):
            return self.e.is_file(**kw)

        def stat(self, **kw):
            if self.path.endswith("4.png"):
                raise FileNotFoundError(self.path)
            return self.e.stat(**kw)

    class Scan(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    real = os.scandir
    monkeypatch.setattr(inventory.os, "scandir", lambda p: Scan(Entry(e) for e in real(p)))
    assert len(list(inventory._entries(str(tmp_path)))) == 9


def test_large_folders_leave_in_chunks(tmp_path, monkeypatch):
    import pandas as pd

    for i in range(25):
        _write(str(tmp_path / f"{i}.png"))
    monkeypatch.setattr(inventory, "_CHUNK", 10)
    assert [len(f) for f in inventory._walker(1000)([pd.DataFrame({"path": [str(tmp_path)]})])] == [10, 10, 5]


@pytest.mark.parametrize("dies_after", ["link", "marker"])
def test_a_retried_copy_knows_its_own_file(tmp_path, monkeypatch, dies_after):
    src, dst = str(tmp_path / "s"), str(tmp_path / "t" / "d")
    _write(src, b"data")

    class Died(Exception):
        pass

    real = os.replace
    if dies_after == "link":
        monkeypatch.setattr(transfer.os, "replace", lambda *a: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            transfer._copy_one(src, dst, "tok")
        monkeypatch.setattr(transfer.os, "replace", real)
    else:
        assert transfer._copy_one(src, dst, "tok") == ("converted", None)
    assert transfer._copy_one(src, dst, "tok") == ("converted", "retry")
    assert transfer._copy_one(src, dst, "another run") == ("target_exists", None)
    transfer._sweep_one(dst, "tok")
    assert os.listdir(tmp_path / "t") == ["d"] and open(dst, "rb").read() == b"data"


def test_two_requests_have_two_outcomes(spark, tree, tmp_path):
    copy = str(tmp_path / "copy.png")
    _write(copy)
    cat = _catalog(spark, tree, ["x.png"], {1: copy})
    reqs = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, None)], "req_id int, id int")
    out = clear_execute(clear_plan(reqs, cat), str(tmp_path / "runs" / "twice")).collect()
    assert sorted((r.req_id, r.status, r.outcome) for r in out) == [
        (1, "cleared", "deleted"), (2, "already_clear", None), (3, "missing_id", None), (4, "missing_id", None)]
