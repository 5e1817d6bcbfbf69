"""Request files are applied once, also when a job is run twice or dies."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cataloom.operators import transfer
from cataloom.plans import ingest
from cataloom.plans.ingest import ingest_job, outcomes
from cataloom.plans.jobs import Catalog, compact_job, edit_job, sync_job
from cataloom.sources.changes import ChangedTable


def _put(folder, name, rows, more=()):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows) + "".join(line + "\n" for line in more))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


@pytest.fixture()
def world(spark, tmp_path):
    old, new = str(tmp_path / "files"), str(tmp_path / "copies")
    for i in range(1, 7):
        os.makedirs(f"{old}/{i % 2}", exist_ok=True)
        with open(f"{old}/{i % 2}/{i}.png", "w") as f:
            f.write(str(i))
    cat = Catalog(str(tmp_path / "catalog"))
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    return cat, old, new, str(tmp_path / "inbox")


class Died(Exception):
    pass


def _dies(*_, **__):
    raise Died("the job died")


def _rows(spark, cat, *cols):
    return {r[0]: tuple(r[1:]) for r in cat.files.read(spark).select("id", *cols).collect()}


def test_edits_of_files_once_and_in_order(spark, world):
    cat, _, _, inbox = world
    _put(inbox, "a.json", [{"req_id": 1, "id": 1, "name": "first"}, {"req_id": 2, "id": "2", "name": "two"}, {"req_id": 3, "id": "x"}], ["{no json"])
    _put(inbox, "b.json", [{"req_id": 1, "id": 1, "name": "second"}, {"req_id": 2, "id": 99, "name": "nobody"}])
    os.utime(f"{inbox}/a.json", (1_700_000_000,) * 2)
    made = ingest_job(spark, cat, "edit", inbox)
    got = {(os.path.basename(r.file), r.given_id): r.status for r in outcomes(spark, cat, made, "edit").collect()}
    assert got == {("a.json", 1): "superseded", ("a.json", 2): "applied", ("a.json", 3): "missing_id", ("b.json", 1): "applied", ("b.json", 2): "not_found"}
    assert [r[0] for r in spark.read.parquet(f"{cat.root}/runs/{made[0]}/lines").where("_corrupt_record is not null").select("_corrupt_record").collect()] == ["{no json"]
    names = _rows(spark, cat, "name")
    assert names[1] == ("second",) and names[2] == ("two",)
    # nothing new: nothing is applied again, also over a later edit
    edit_job(spark, cat, spark.createDataFrame([(1, 1, "by hand", None, None)], "req_id int, id int, name string, class_name string, prompt string"))
    assert ingest_job(spark, cat, "edit", inbox) == [] and _rows(spark, cat, "name")[1] == ("by hand",)
    _put(inbox, "c.json", [{"req_id": 7, "id": 3, "name": "three"}])
    _put(inbox, "d.json", [{"req_id": 7, "id": 4, "name": "four"}])
    assert len(ingest_job(spark, cat, "edit", inbox, files_per_batch=1)) == 2
    names = _rows(spark, cat, "name")
    assert [names[i][0] for i in (1, 2, 3, 4)] == ["by hand", "two", "three", "four"]


@pytest.mark.parametrize("where", ["half-way through the copies", "before the outcome is recorded"])
def test_copies_of_a_job_that_died(spark, world, monkeypatch, where):
    cat, old, new, inbox = world
    _put(inbox, "a.json", [{"req_id": i, "id": i} for i in (1, 2, 3, 1, 77)])
    if where.startswith("half"):
        def some(plan, out_path, token, mode):
            row = plan.where("status = 'converted'").orderBy("req_id").first()
            assert transfer._copy_one(row.origin_path, row.new_path, token) == ("converted", None)
            os.makedirs(f"{out_path}/_temporary/0")
            _dies()
        monkeypatch.setattr(ingest.tr, "convert_execute", some)
    else:
        monkeypatch.setattr(ChangedTable, "append", _dies)
    with pytest.raises(StreamingQueryException):
        ingest_job(spark, cat, "convert", inbox, old_root=old, new_root=new)
    assert all(t == (None,) for t in _rows(spark, cat, "target_path").values())
    monkeypatch.undo()
    # files that come meanwhile make a batch of their own
    _put(inbox, "b.json", [{"req_id": 1, "id": 4}, {"req_id": 2, "id": 1}])
    made = ingest_job(spark, cat, "convert", inbox, old_root=old, new_root=new)
    first = outcomes(spark, cat, made[:1], "convert")
    assert sorted((r.given_id, r.id, r.status, r.outcome) for r in first.collect()) == [
        (1, 1, "converted", "converted"), (1, 1, "target_exists", None), (2, 2, "converted", "converted"), (3, 3, "converted", "converted"), (77, 77, "not_found", None)]
    assert first.where("outcome = 'converted'").select("id").distinct().count() == 3
    assert {r.id: r.status for r in outcomes(spark, cat, made[1:], "convert").collect()} == {4: "converted", 1: "target_exists"}
    targets = _rows(spark, cat, "target_path")
    assert {i for i, (t,) in targets.items() if t} == {1, 2, 3, 4} and all(os.path.exists(t) for t, in targets.values() if t)
    assert not [n for _, _, names in os.walk(new) for n in names if n.endswith((".done", ".part"))]
    assert ingest_job(spark, cat, "convert", inbox, old_root=old, new_root=new) == []


def test_clears_of_a_job_that_died(spark, world, monkeypatch):
    cat, old, new, inbox = world
    _put(f"{inbox}/copy", "a.json", [{"req_id": 1, "id": 1}, {"req_id": 2, "id": 2}])
    ingest_job(spark, cat, "convert", f"{inbox}/copy", old_root=old, new_root=new)
    _put(f"{inbox}/clear", "a.json", [{"req_id": 1, "id": 1}, {"req_id": 2, "id": 3}])
    monkeypatch.setattr(ChangedTable, "append", _dies)
    with pytest.raises(StreamingQueryException):
        ingest_job(spark, cat, "clear", f"{inbox}/clear")
    monkeypatch.undo()
    made = ingest_job(spark, cat, "clear", f"{inbox}/clear")
    assert {r.id: (r.status, r.outcome) for r in outcomes(spark, cat, made, "clear").collect()} == {1: ("cleared", "deleted"), 3: ("already_clear", None)}
    targets = _rows(spark, cat, "target_path")
    assert targets[1] == (None,) and targets[2][0] and os.path.exists(targets[2][0])


@pytest.mark.parametrize("dies_in", ["claimed", "upload_status", "record"])
def test_uploads_of_a_job_that_died(spark, world, monkeypatch, tmp_path, dies_in):
    cat, _, _, inbox = world
    public = str(tmp_path / "public")
    for i in range(4):
        (tmp_path / f"up{i}.png").write_text(f"upload {i}")
    _put(inbox, "a.json", [{"upload_id": i, "file_list_id": 5 if i < 3 else 6, "upload_path": str(tmp_path / f"up{i}.png")} for i in range(4)]
         + [{"upload_id": 9, "file_list_id": 5}, {"upload_id": 10, "file_list_id": 5, "upload_path": str(tmp_path / "nosuch.png")}])
    monkeypatch.setattr(*((ingest, "image_record") if dies_in == "record" else (ingest.im, dies_in)), _dies)
    with pytest.raises(StreamingQueryException):
        ingest_job(spark, cat, "image", inbox, public_root=public)
    monkeypatch.undo()
    made = ingest_job(spark, cat, "image", inbox, public_root=public)
    got = {r.given_id: (r.status, r.outcome) for r in outcomes(spark, cat, made, "image").collect()}
    assert got == {**{i: ("numbered", "placed") for i in range(4)}, 9: ("no_file", None), 10: ("upload_missing", None)}
    rows = cat.images.read(spark).collect()
    assert len(rows) == 5 and len({(r.file_list_id, r.sort) for r in rows}) == 5
    held = sorted(open(os.path.join(public, r.image.lstrip("/"))).read() for r in rows if r.image)
    assert held == [f"upload {i}" for i in range(4)]
    assert ingest_job(spark, cat, "image", inbox, public_root=public) == [] and cat.images.read(spark).count() == 5


def test_a_batch_that_was_compacted_away_is_not_appended_again(spark, world):
    cat, _, _, inbox = world
    _put(inbox, "a.json", [{"req_id": 1, "id": 1, "name": "first"}])
    run, = ingest_job(spark, cat, "edit", inbox)
    change = spark.read.parquet(f"{cat.root}/file_list/changes/{run}")
    change = spark.createDataFrame(change.collect(), change.schema)
    for n in range(2):
        edit_job(spark, cat, spark.createDataFrame([(1, 1, f"later {n}", None, None)], "req_id int, id int, name string, class_name string, prompt string"))
        compact_job(spark, cat)
    assert not os.path.exists(f"{cat.root}/file_list/changes/{run}")
    cat.files.append(run, change.withColumn("at", F.lit(1 << 62)))
    assert _rows(spark, cat, "name")[1] == ("later 1",)
