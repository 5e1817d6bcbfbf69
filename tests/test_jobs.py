"""End-to-end jobs on a throw-away tree: sync, convert, clear, edits,
image upload and gallery, each publishing catalog snapshots."""

import json
import os

import pytest

from cataloom.plans import jobs
from cataloom.plans.jobs import (Catalog, clear_job, convert_job, convert_record, edit_job, gallery_job, image_job, image_record, now_run_ts,
                                 sync_job)
from cataloom.sources.requests import malformed, read_requests, valid

BASE_URL = "http://127.0.0.1:5000"


def _write(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _jsonl(path, rows, extra_lines=()):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
        for line in extra_lines:
            f.write(line + "\n")


@pytest.fixture()
def world(tmp_path):
    old = str(tmp_path / "file_path")
    new = str(tmp_path / "file_new_path")
    for rel in ["a/1.png", "a/2.png", "b/3.png", "4.png"]:
        _write(os.path.join(old, rel), rel.encode())
    return old, new, Catalog(str(tmp_path / "catalog")), tmp_path


def test_read_requests_keeps_bad_lines_apart(spark, tmp_path):
    path = str(tmp_path / "req" / "convert.jsonl")
    _jsonl(path, [{"req_id": 1, "id": 3}, {"req_id": 2, "id": "4"}, {"req_id": 3, "id": "x1"}],
           extra_lines=["{not json"])
    df = read_requests(spark, path, "convert").cache()
    good = {r.req_id: r.id for r in valid(df).collect()}
    assert good == {1: 3, 2: 4, 3: None}
    assert [r._corrupt_record for r in malformed(df).collect()] == ["{not json"]


def test_sync_convert_clear_roundtrip(spark, world):
    old, new, cat, tmp = world
    s1 = sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    assert s1 == {"total_files_in_directory": 4, "new_files_added": 4, "total_files_in_database": 4,
                  "missing_files": 0, "refused_files": 0}
    rows = {r.origin_path: r for r in cat.files.read(spark).collect()}
    ids = [rows[os.path.join(old, p)].id for p in ["4.png", "a/1.png", "a/2.png", "b/3.png"]]
    assert ids == [1, 2, 3, 4]                       # dense, in path order
    os.unlink(os.path.join(old, "a/2.png"))
    _write(os.path.join(old, "c/5.png"))
    s2 = sync_job(spark, cat, [old], "2025-05-02 00:00:00")
    assert s2 == {"total_files_in_directory": 4, "new_files_added": 1, "total_files_in_database": 5,
                  "missing_files": 1, "refused_files": 0}
    assert cat.files.current() == 1

    req_path = str(tmp / "req" / "convert.jsonl")
    _jsonl(req_path, [{"req_id": 1, "id": 2}, {"req_id": 2, "id": 2}, {"req_id": 3, "id": 3},
                      {"req_id": 4, "id": 99}, {"req_id": 5}])
    res = {r.req_id: (r.status, r.outcome) for r in
           convert_job(spark, cat, valid(read_requests(spark, req_path, "convert")), old, new).collect()}
    assert res == {1: ("converted", "converted"), 2: ("target_exists", None), 3: ("source_missing", None),
                   4: ("not_found", None), 5: ("missing_id", None)}
    assert open(os.path.join(new, "a/1.png"), "rb").read() == b"a/1.png"
    after = {r.id: r.target_path for r in cat.files.read(spark).collect()}
    assert after[2] == os.path.join(new, "a/1.png") and after[3] is None

    clear_req = str(tmp / "req" / "clear.jsonl")
    _jsonl(clear_req, [{"req_id": 1, "id": 2}, {"req_id": 2, "id": 2}, {"req_id": 3, "id": 1}])
    res = {r.req_id: (r.status, r.outcome) for r in
           clear_job(spark, cat, valid(read_requests(spark, clear_req, "clear"))).collect()}
    assert res == {1: ("cleared", "deleted"), 2: ("already_clear", None), 3: ("already_clear", None)}
    assert not os.path.exists(os.path.join(new, "a/1.png"))
    assert {r.id: r.target_path for r in cat.files.read(spark).collect()}[2] is None


def test_edits(spark, world):
    old, _, cat, tmp = world
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    path = str(tmp / "req" / "edit.jsonl")
    _jsonl(path, [{"req_id": 1, "id": "1", "name": "first", "class_name": "c", "prompt": "p"}, {"req_id": 2, "id": 1, "name": "second", "class_name": "c"},
                  {"req_id": 3, "id": 1, "name": "x" * 51}, {"req_id": 4, "id": 99, "name": "n"}, {"req_id": 5, "name": "n"}, {"req_id": 6, "id": 2, "prompt": "é" * 255}])
    report = edit_job(spark, cat, valid(read_requests(spark, path, "edit")), "2025-06-01 00:00:00.5")
    assert {r.req_id: r.status for r in report.collect()} == {1: "superseded", 2: "applied", 3: "rejected", 4: "not_found", 5: "missing_id", 6: "applied"}
    rows = {r.id: r for r in cat.files.read(spark).collect()}
    assert rows[1].name == "second" and rows[1].prompt is None and str(rows[1].updated_at) == "2025-06-01 00:00:01"
    assert rows[2].prompt == "é" * 255 and rows[3].updated_at is None


def test_sync_asks_for_files_of_other_roots(spark, world):
    old, new, cat, tmp = world
    _write(os.path.join(new, "9.png"))
    sync_job(spark, cat, [old, new], "2025-05-01 00:00:00")
    os.unlink(os.path.join(old, "4.png"))
    stats = sync_job(spark, cat, [old], "2025-05-02 00:00:00")
    assert {r.origin_path: r.path_check for r in cat.files.read(spark).collect()}[os.path.join(new, "9.png")] is True
    assert stats["missing_files"] == 1 and stats["total_files_in_database"] == 5


def test_nothing_is_published_after_an_unreadable_folder(spark, world, monkeypatch):
    old, _, cat, _ = world
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")

    def fails(*_):
        raise jobs_unreadable("a folder")

    from cataloom.sources.inventory import UnreadableFolder as jobs_unreadable
    monkeypatch.setattr(jobs, "walk", fails)
    with pytest.raises(jobs_unreadable):
        sync_job(spark, cat, [old])
    assert cat.files.current() == 0


def test_copies_are_recorded_after_a_conflict(spark, world, monkeypatch):
    """Another writer publishes between reading and claiming."""
    old, new, cat, _ = world
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    real, other = jobs.ch.copy_changes, []

    def slow(*a, **kw):
        if not other:
            version = cat.files.current()
            other.append(cat.files.publish(cat.files.read(spark, version).where("id <> 4"), version))
        return real(*a, **kw)

    monkeypatch.setattr(jobs.ch, "copy_changes", slow)
    out = convert_job(spark, cat, spark.createDataFrame([(1, 2), (2, 4)], "req_id long, id int"), old, new)
    assert {r.req_id: r.outcome for r in out.collect()} == {1: "converted", 2: "converted"}
    after = {r.id: r.target_path for r in cat.files.read(spark).collect()}
    assert set(after) == {1, 2, 3} and after[2] == os.path.join(new, "a/1.png")


def test_a_run_that_died_after_copying_is_recorded_later(spark, world, monkeypatch):
    old, new, cat, _ = world
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    with monkeypatch.context() as m:
        m.setattr(jobs, "convert_record", lambda spark, catalog, out_path, run_ts: out_path)
        out_path = convert_job(spark, cat, spark.createDataFrame([(1, 2)], "req_id long, id int"), old, new)
    assert os.path.exists(os.path.join(new, "a/1.png")) and cat.files.current() == 0
    for _ in range(2):
        convert_record(spark, cat, out_path)
        assert {r.id: r.target_path for r in cat.files.read(spark).collect()}[2] == os.path.join(new, "a/1.png")


def test_failed_uploads_get_no_number_and_no_row(spark, world):
    _, _, cat, tmp = world
    public, there = str(tmp / "public"), [str(tmp / "uploads" / n) for n in ("a", "b", "c")]
    for p in there:
        _write(p)
    uploads = spark.createDataFrame([(1, 7, str(tmp / "uploads" / "never"), True), (2, 7, there[0], True), (3, None, there[1], True), (4, 7, None, False), (5, 7, there[2], True)],
                                    "upload_id long, file_list_id int, upload_path string, has_file boolean")
    out = {r.upload_id: (r.status, r.sort, r.image) for r in image_job(spark, cat, uploads, public).collect()}
    assert out == {1: ("upload_missing", None, None), 2: ("numbered", 1, "/images/img7_001.png"), 3: ("missing_id", None, None), 4: ("no_file", 2, None),
                   5: ("numbered", 3, "/images/img7_003.png")}
    assert sorted((r.file_list_id, r.sort, r.image) for r in cat.images.read(spark).collect()) == [
        (7, 1, "/images/img7_001.png"), (7, 2, None), (7, 3, "/images/img7_003.png")]
    assert os.path.exists(there[1]) and not os.path.exists(os.path.join(public, "images", "imgnull_001.png"))
    # recording the run again adds nothing
    runs = [n for n in os.listdir(os.path.join(cat.root, "runs")) if n.startswith("image") and not n.endswith("-moves")]
    image_record(spark, cat, os.path.join(cat.root, "runs", runs[0]))
    assert cat.images.read(spark).count() == 3


UPLOADS = "upload_id long, file_list_id int, upload_path string, has_file boolean"


@pytest.mark.parametrize("between", ["claim_numbers", "image_place", "image_record"])
def test_two_image_jobs_at_once_lose_nothing(spark, world, monkeypatch, between):
    """A second job runs as the first one is about to claim its numbers, to
    move its files or to record its rows."""
    _, _, cat, tmp = world
    public, mine, other = str(tmp / "public"), str(tmp / "uploads" / "mine"), str(tmp / "uploads" / "other")
    _write(mine, b"mine")
    _write(other, b"other")
    where = jobs if between == "image_record" else jobs.im
    real, met = getattr(where, between), []

    def late(*args, **kw):
        made = real(*args, **kw) if between == "claim_numbers" else None
        if not met:
            met.append(1)
            met.append(image_job(spark, cat, spark.createDataFrame([(1, 5, other, True), (2, 5, None, False)], UPLOADS), public).collect())
        return real(*args, **kw) if made is None else made

    monkeypatch.setattr(where, between, late)
    first = {r.upload_id: r for r in image_job(spark, cat, spark.createDataFrame([(1, 5, mine, True)], UPLOADS), public).collect()}
    second = {r.upload_id: r for r in met[1]}
    assert first[1].outcome == second[1].outcome == "placed" and first[1].image != second[1].image
    for r, body in ((first[1], b"mine"), (second[1], b"other")):
        with open(public + r.image, "rb") as f:
            assert f.read() == body
    rows = [(r.file_list_id, r.sort, r.image) for r in cat.images.read(spark).collect()]
    assert sorted(r[1] for r in rows) == [1, 2, 3] and {r[2] for r in rows} == {first[1].image, second[1].image, None}
    ids = [r.id for r in cat.images.read(spark).collect()]
    assert len(set(ids)) == 3


def test_a_file_in_the_way_stays(spark, world):
    _, _, cat, tmp = world
    public, own, there = str(tmp / "public"), str(tmp / "uploads" / "own"), str(tmp / "public" / "images" / "img5_001.png")
    _write(own, b"own")
    _write(there, b"not ours")
    ask = lambda *rows: image_job(spark, cat, spark.createDataFrame(list(rows), UPLOADS), public).collect()
    assert [(r.outcome, r.sort) for r in ask((1, 5, own, True))] == [("target_exists", 1)]
    assert open(there, "rb").read() == b"not ours" and open(own, "rb").read() == b"own" and cat.images.read(spark).count() == 0
    # the claimed number stays unused, and the next try goes on
    assert [(r.outcome, r.image) for r in ask((1, 5, own, True))] == [("placed", "/images/img5_002.png")]


def test_a_retried_move_knows_its_own_file(tmp_path):
    src, dest = str(tmp_path / "up"), str(tmp_path / "images" / "img5_001.png")
    _write(src, b"own")
    identity = jobs.im._identity(src)
    os.makedirs(os.path.dirname(dest))
    os.link(src, dest)  # an attempt that died between link and unlink
    assert jobs.im._place(src, dest, identity) == ("placed", None) and not os.path.exists(src)
    assert jobs.im._place(src, dest, identity) == ("placed", "retry")
    os.unlink(dest)
    _write(dest, b"not ours, and the upload is gone")
    assert jobs.im._place(src, dest, identity)[0] == "upload_missing"


def test_claims_that_image_rows_show_are_dropped(spark, world):
    _, _, cat, tmp = world
    for i in range(3):
        image_job(spark, cat, spark.createDataFrame([(1, 5, None, False), (2, 6, None, False)], UPLOADS), str(tmp / "public"))
    assert cat.claims.read(spark).count() == 2 and cat.images.read(spark).count() == 6


def test_galleries_of_requested_rows(spark, world):
    _, _, cat, tmp = world
    public = str(tmp / "public")
    for n in ("img1_001", "img1_002", "img2_001"):
        _write(os.path.join(public, "images", n + ".png"))
    images = spark.createDataFrame([(1, 1, "/images/img1_001.png", 1), (2, 1, "/images/gone.png", 2), (3, 1, None, 3), (4, 2, "/images/img2_001.png", 1),
                                    (5, 3, "/images/gone.png", 1), (6, 4, "/images/../images/img1_002.png", 1)], "id int, file_list_id int, image string, sort int")
    cat.images.publish(jobs.im.conform(images, "file_image"), None)
    asked = spark.createDataFrame([(1,), (1,), (3,), (4,), (8,), (None,)], "file_list_id int")
    got = sorted((r.file_list_id or 0, r.status, r.sort or 0, r.image_url or "") for r in gallery_job(spark, cat, public, BASE_URL, asked).collect())
    assert got == [(0, "no_image_rows", 0, ""), (1, "ok", 1, "/static//images/img1_001.png"), (3, "no_image_files", 0, ""),
                   (4, "ok", 1, "/static//images/../images/img1_002.png"), (8, "no_image_rows", 0, "")]


def test_scratch_tables_are_deleted(spark, world):
    old, new, cat, _ = world
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    folder = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "tables")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    convert_job(spark, cat, spark.createDataFrame([(1, 2)], "req_id long, id int"), old, new).collect()
    assert set(os.listdir(folder)) == before


def test_image_upload_and_gallery(spark, world):
    old, _, cat, tmp = world
    sync_job(spark, cat, [old], "2025-05-01 00:00:00")
    public = str(tmp / "public")
    staged = []
    for i in range(3):
        p = str(tmp / "uploads" / f"tmp{i}")
        _write(p, f"img{i}".encode())
        staged.append(p)
    req = str(tmp / "req" / "image.jsonl")
    _jsonl(req, [{"upload_id": 1, "file_list_id": 2, "upload_path": staged[0]},
                 {"upload_id": 2, "file_list_id": 2, "upload_path": staged[1]},
                 {"upload_id": 3, "file_list_id": 3},
                 {"upload_id": 4, "file_list_id": 3, "upload_path": staged[2]}])
    uploads = valid(read_requests(spark, req, "image"))
    out = {r.upload_id: (r.sort, r.image, r.outcome) for r in image_job(spark, cat, uploads, public, now_run_ts()).collect()}
    assert out == {1: (1, "/images/img2_001.png", "placed"), 2: (2, "/images/img2_002.png", "placed"),
                   3: (1, None, None), 4: (2, "/images/img3_002.png", "placed")}
    assert cat.images.read(spark).count() == 4
    assert open(os.path.join(public, "images", "img2_002.png"), "rb").read() == b"img1"
    # next upload for row 2 continues the numbering from the stored maximum
    p = str(tmp / "uploads" / "tmp9")
    _write(p)
    req2 = str(tmp / "req" / "image2.jsonl")
    _jsonl(req2, [{"upload_id": 9, "file_list_id": 2, "upload_path": p}])
    again = image_job(spark, cat, valid(read_requests(spark, req2, "image")), public).first()
    assert (again.sort, again.image) == (3, "/images/img2_003.png")
    os.unlink(os.path.join(public, "images", "img2_001.png"))
    g = sorted((r.file_list_id, r.sort, r.full_url) for r in gallery_job(spark, cat, public, BASE_URL).collect())
    assert g == [(2, 2, BASE_URL + "/static//images/img2_002.png"), (2, 3, BASE_URL + "/static//images/img2_003.png"),
                 (3, 2, BASE_URL + "/static//images/img3_002.png")]
