"""The walk as a data source: equal to the walk, and prefixes choose folders."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cataloom.sources import files, inventory
from cataloom.sources.files import NAME, FilesReader, register
from cataloom.sources.inventory import UnreadableFolder, walk


@pytest.fixture()
def tree(tmp_path):
    root, rng = tmp_path / "files", random.Random(5)
    for i in range(120):
        folder = root / "/".join(rng.choice("abc") for _ in range(rng.randrange(5)))
        os.makedirs(folder, exist_ok=True)
        (folder / f"{i}.png").write_bytes(b"x" * i)
    (root / "a" / ".hidden").touch()
    os.makedirs(root / "ab")
    (root / "ab" / "0.png").touch()
    os.symlink(root / "a", root / "link")
    return str(root)


def _opened(monkeypatch):
    seen, real = [], os.scandir
    monkeypatch.setattr(inventory.os, "scandir", lambda p: (seen.append(p), real(p))[1])
    return seen


def _read(reader):
    return sorted(p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist())


@pytest.mark.parametrize("options", [{}, {"tasks": "1"}, {"tasks": "3"}])
def test_equal_to_the_walk(spark, tree, options):
    register(spark)
    got = spark.read.format(NAME).options(**options).load(tree)
    want = sorted(map(tuple, walk(spark, [tree]).collect()))
    assert got.columns == ["origin_path", "length", "mtime"] and len(want) == 122
    assert sorted(map(tuple, got.collect())) == want
    two = spark.read.format(NAME).option("roots", json.dumps([f"{tree}/a", f"{tree}/b", f"{tree}/a/b"])).load()
    assert sorted(map(tuple, two.collect())) == [r for r in want if r[0].startswith((f"{tree}/a/", f"{tree}/b/"))]


def test_queries_on_one_table(spark, tree):
    register(spark)
    source, plain = spark.read.format(NAME).load(tree), walk(spark, [tree])
    path = F.col("origin_path")
    for cond in (path.startswith(f"{tree}/a"), path.endswith("7.png"), (F.col("length") > 50) & path.contains("/b/")):
        assert sorted(map(tuple, source.where(cond).collect())) == sorted(map(tuple, plain.where(cond).collect()))
    under = [f"{tree}/a/b", f"{tree}/c/", f"{tree}/ab/0.png", "/nosuch"]
    got = spark.read.format(NAME).option("under", json.dumps(under)).load(tree)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in plain.collect() if r.origin_path.startswith(tuple(under)))


def test_a_prefix_opens_no_other_folder(tree, monkeypatch):
    everything, seen = _read(FilesReader({"path": tree})), _opened(monkeypatch)
    for under, may in (([f"{tree}/a/b"], lambda f: f in (tree, f"{tree}/a") or f.startswith(f"{tree}/a/b")),
                       ([f"{tree}/ab/0.png"], lambda f: f in (tree, f"{tree}/ab")),
                       ([f"{tree}/ab/0.png", f"{tree}/c/c"], lambda f: f in (tree, f"{tree}/ab", f"{tree}/c") or f.startswith(f"{tree}/c/c")),
                       ([""], lambda f: True), ([], lambda f: False), (["/elsewhere/x"], lambda f: False)):
        for tasks in (1, 4):
            seen.clear()
            assert _read(FilesReader({"path": tree, "tasks": tasks, "under": json.dumps(under)})) == [p for p in everything if p.startswith(tuple(under))]
            assert all(may(f) for f in seen), (under, seen)


def test_planning_is_bounded(tree, monkeypatch):
    whole = _read(FilesReader({"path": tree, "tasks": 8}))
    monkeypatch.setattr(files, "PLANNED_ENTRIES", 3)
    reader = FilesReader({"path": tree, "tasks": 8})
    assert len(reader.partitions()) == 1 and _read(reader) == whole
    monkeypatch.setattr(files, "PLANNED_ENTRIES", 10_000)
    assert 4 <= len(FilesReader({"path": tree, "tasks": 8}).partitions()) <= 8
    monkeypatch.setattr(files, "_CHUNK", 10)
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10 and _read(reader) == whole


def test_roots_that_are_not_there_and_folders_that_are_closed(tree, monkeypatch):
    with pytest.raises(FileNotFoundError):
        FilesReader({"path": f"{tree}/nosuch"}).partitions()

    def closed(folder):
        raise PermissionError(13, "Permission denied")
    reader = FilesReader({"path": tree})
    parts = reader.partitions()
    monkeypatch.setattr(files, "_entries", closed)
    with pytest.raises(UnreadableFolder):
        [list(reader.read(p)) for p in parts]
