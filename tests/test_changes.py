"""Changes beside the snapshots: folding, what a batch costs, compaction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cataloom.operators import changes as ch
from cataloom.operators import edits as ed
from cataloom.operators import transfer as tr
from cataloom.plans import jobs
from cataloom.plans.jobs import Catalog, clear_job, clear_record, compact_job, edit_job, sync_job
from cataloom.schema import conform
from cataloom.sources.store import SnapshotConflict

TS = "2025-03-0{} 00:00:00"


def catalog(spark, n=40):
    rows = [(i, f"n{i}", "p", "c", f"/old/{i}", [None, "", f"/new/{i}", f"/new/x{i}"][i % 4]) for i in range(1, n)]
    return conform(spark.createDataFrame(rows, "id int, name string, prompt string, class string, origin_path string, target_path string"), "file_list")


def test_fold_equals_batches_one_after_another(spark):
    """Random batches, each also applied by rewriting the catalog."""
    rng = random.Random(4)
    start = now = catalog(spark).checkpoint()
    changes = None
    for k in range(1, 9):
        kind, ts = rng.choice(["edit", "copy", "clear"]) if k > 3 else ("edit", "copy", "clear")[k - 1], TS.format(k)
        ids = [rng.choice([None, rng.randrange(1, 50)]) for _ in range(15)]
        if kind == "edit":
            batch = spark.createDataFrame([(r, i, rng.choice([None, f"e{k}", "x" * 51]), "c", f"p{r}") for r, i in enumerate(ids)],
                                          "req_id int, id int, name string, class_name string, prompt string")
            more, now = ch.edit_changes(now, batch, ts, k, "r"), ed.apply_edits(now, batch, ts)
        elif kind == "copy":
            batch = spark.createDataFrame([(i, rng.choice(["converted", "failed"]), f"/new/{rng.choice(['x', ''])}{i}") for i in ids], "id int, outcome string, new_path string")
            more, now = ch.copy_changes(batch, ts, k, "r"), tr.convert_commit(now, batch, ts, "outcome")
        else:
            batch = spark.createDataFrame([(i, "cleared", f"/new/{rng.choice(['x', ''])}{i}") for i in ids], "id int, status string, target_path string")
            more, now = ch.clear_changes(batch, k, "r"), tr.clear_commit(now, batch)
        now = now.checkpoint()
        changes = more if changes is None else changes.unionByName(more)
    got = ch.fold(start, changes.checkpoint().repartition(7))
    assert got.columns == start.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, now.collect()), key=repr)


def test_nothing_to_fold(spark):
    none = spark.createDataFrame([], ch.CHANGE)
    assert ch.fold(catalog(spark), none).count() == 39 and ch.fold(catalog(spark).limit(0), none).collect() == []


@pytest.fixture()
def world(spark, tmp_path):
    root = str(tmp_path / "files")
    for i in range(300):
        os.makedirs(f"{root}/{i % 7}", exist_ok=True)
        open(f"{root}/{i % 7}/{i}.png", "w").close()
    cat = Catalog(str(tmp_path / "catalog"))
    sync_job(spark, cat, [root], TS.format(1))
    return cat, root


def _edit(spark, cat, *rows):
    return edit_job(spark, cat, spark.createDataFrame([(k, i, n, "c", "p") for k, (i, n) in enumerate(rows)], "req_id int, id int, name string, class_name string, prompt string"), TS.format(2))


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def names(spark, cat):
    return {r.id: r.name for r in cat.files.read(spark).collect() if r.name}


def test_a_batch_costs_what_it_changes(spark, world):
    cat, _ = world
    before = _size(f"{cat.root}/file_list")
    _edit(spark, cat, (3, "three"))
    one = _size(f"{cat.root}/file_list/changes")
    assert cat.files.current() == 0 and one < 8_000 and _size(f"{cat.root}/file_list") == before + one
    _edit(spark, cat, *[(i, f"all {i}") for i in range(1, 301)])
    assert names(spark, cat) == {i: f"all {i}" for i in range(1, 301)}


def test_compaction_holds_what_it_read(spark, world, monkeypatch):
    """A batch that is appended during a compaction stays open beside it."""
    cat, _ = world
    _edit(spark, cat, (1, "first"), (2, "second"))
    real, met = jobs.ChangedTable._prepare, []

    def late(self, *args):
        if not met:
            met.append(1)
            _edit(spark, cat, (2, "meanwhile"), (4, "new"))
        real(self, *args)

    monkeypatch.setattr(jobs.ChangedTable, "_prepare", late)
    assert compact_job(spark, cat) == 1
    assert names(spark, cat) == {1: "first", 2: "meanwhile", 4: "new"} and len(cat.files.current().runs) == 1
    assert compact_job(spark, cat) == 2 and cat.files.current().runs == ()
    assert names(spark, cat) == {1: "first", 2: "meanwhile", 4: "new"}
    # batches that the snapshot before held already are gone, and an idle compaction does nothing
    assert len(os.listdir(f"{cat.root}/file_list/changes")) == 1 and compact_job(spark, cat) == 2


def test_a_sync_keeps_appended_changes(spark, world):
    cat, root = world
    _edit(spark, cat, (5, "five"), (301, "not there yet"))
    open(f"{root}/zz.png", "w").close()
    assert sync_job(spark, cat, [root], TS.format(3))["new_files_added"] == 1
    assert names(spark, cat) == {5: "five"} and cat.files.current().runs == ()
    _edit(spark, cat, (301, "there"))
    assert names(spark, cat) == {5: "five", 301: "there"}


def test_two_compactions_do_not_both_win(spark, world):
    cat, _ = world
    _edit(spark, cat, (1, "first"))
    version = cat.files.current()
    mine = cat.files.read(spark, version)
    compact_job(spark, cat)
    with pytest.raises(SnapshotConflict):
        cat.files.publish(mine, version)
    assert names(spark, cat) == {1: "first"}


def test_an_unfinished_batch_is_not_read(spark, world):
    cat, _ = world
    _edit(spark, cat, (1, "first"))
    run = cat.files.current().runs[0]
    os.unlink(f"{cat.root}/file_list/changes/{run}/_SUCCESS")
    assert names(spark, cat) == {}
    cat.files.append(run, spark.createDataFrame([(1, 1, run, ("again", "c", "p"), None, None, None)], ch.CHANGE))
    cat.files.append(run, spark.createDataFrame([(1, 1, run, ("twice", "c", "p"), None, None, None)], ch.CHANGE))
    assert names(spark, cat) == {1: "again"}


def test_a_clear_that_is_recorded_late_spares_a_new_copy(spark, world, monkeypatch):
    cat, root = world
    cat.files.append("copy", ch.copy_changes(spark.createDataFrame([(1, "converted", f"{root}/nowhere")], "id int, outcome string, new_path string"), TS.format(2), 1, "copy"))
    held = []
    monkeypatch.setattr(jobs, "clear_record", lambda spark, cat, path: held.append(path))
    clear_job(spark, cat, spark.createDataFrame([(1, 1)], "req_id int, id int"))
    cat.files.append("other", ch.copy_changes(spark.createDataFrame([(1, "converted", f"{root}/other")], "id int, outcome string, new_path string"), TS.format(3), 2, "other"))
    clear_record(spark, cat, held[0])
    assert [r.target_path for r in cat.files.read(spark).where(F.col("id") == 1).collect()] == [f"{root}/other"]
