"""Existence by folder: equal to asking for each path, with few system calls."""

import os
import random

import pyarrow as pa
import pytest

from cataloom.sources import inventory
from cataloom.sources.inventory import _ROW, by_folder, existing_paths, probe_missing


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "files"
    for i in range(60):
        os.makedirs(root / str(i % 5) / "sub", exist_ok=True)
        (root / str(i % 5) / f"{i}.png").write_bytes(b"x")
    os.symlink(root / "0" / "0.png", root / "0" / "link.png")
    os.symlink(root / "nowhere", root / "0" / "dangling.png")
    os.symlink(root / "1", root / "linked")
    return str(root)


def _candidates(root):
    rng = random.Random(3)
    paths = [f"{root}/{rng.randrange(7)}/{rng.randrange(80)}.png" for _ in range(400)]
    paths += [f"{root}/linked/{i}.png" for i in range(12)] + [f"{root}/0/0.png/{i}" for i in range(6)]
    return paths + [f"{root}/0/link.png", f"{root}/0/dangling.png", f"{root}/0/sub", f"{root}/0/sub/", f"{root}/0/.", f"{root}/0/..",
                    f"{root}//0//0.png", f"{root}/0/0.png/", "", "/", ".", "nosuch", "cataloom", "/etc/passwd", f"{root}/0/a\u0000b",
                    f"{root}/0/" + "y" * 300, f"{root}/" + "z/" * 2500 + "q"]


@pytest.mark.parametrize("least, ratio", [(1, 1), (1, 32), (4, 32), (1000, 1)])
def test_equal_to_asking_each(tree, monkeypatch, least, ratio):
    monkeypatch.setattr(inventory, "_LIST_FROM", least)
    monkeypatch.setattr(inventory, "_LIST_RATIO", ratio)
    paths = _candidates(tree)
    assert existing_paths(paths) == {p for p in paths if os.path.exists(p)}
    assert existing_paths([]) == set()


class _Calls:
    def __init__(self, monkeypatch):
        self.listed = self.asked = self.entries = 0
        scan, exists = os.scandir, os.path.exists
        calls = self

        class Scan:
            def __init__(self, path):
                calls.listed += 1
                self.it = scan(path)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.it.close()

            def __iter__(self):
                for e in self.it:
                    calls.entries += 1
                    yield e

        def asks(path):
            calls.asked += 1
            return exists(path)

        monkeypatch.setattr(inventory.os, "scandir", Scan)
        monkeypatch.setattr(inventory.os.path, "exists", asks)


def test_one_listing_a_folder(tmp_path, monkeypatch):
    for i in range(1000):
        os.makedirs(tmp_path / str(i % 4), exist_ok=True)
        (tmp_path / str(i % 4) / f"{i}.png").touch()
    paths = [f"{tmp_path}/{i % 4}/{i}.png" for i in range(0, 2000)] + [f"{tmp_path}/gone/{i}.png" for i in range(5000)]
    calls = _Calls(monkeypatch)
    assert len(existing_paths(paths)) == 1000
    assert (calls.listed, calls.asked) == (5, 0)


def test_a_large_folder_is_not_listed_for_few_names(tmp_path, monkeypatch):
    for i in range(3000):
        (tmp_path / f"{i}.png").touch()
    calls = _Calls(monkeypatch)
    asked = [f"{tmp_path}/{n}" for n in ("1.png", "2.png", "3.png", "no", "nor", "neither")]
    assert len(existing_paths(asked)) == 3
    assert calls.asked <= 6 and calls.entries <= 32 * 6 + 1
    calls.asked = calls.listed = 0
    assert len(existing_paths(asked[:2])) == 2 and (calls.listed, calls.asked) == (0, 2)


def test_rows_are_answered_in_bounded_pieces(tree, monkeypatch):
    monkeypatch.setattr(inventory, "_ASKED_ROWS", 100)
    paths = sorted(_candidates(tree))
    batches = [pa.RecordBatch.from_pydict({"n": list(range(len(part))), "f": pa.array([None] * len(part), pa.bool_()), "p": part})
               for part in (paths[i:i + 30] for i in range(0, len(paths), 30))]
    got = list(inventory._asker(2, 1)(iter(batches)))
    assert [b.num_rows for b in got] == [b.num_rows for b in batches] and got[0].schema.names == ["n", "f", "p"]
    assert [f for b in got for f in b.column(1).to_pylist()] == [os.path.exists(p) or None for p in paths]
    assert list(inventory._asker(2, 1)(iter([]))) == []


def test_probe_of_a_table(spark, tree):
    """Known rows, null paths, repeated rows and other columns stay as they are."""
    paths = [p for p in _candidates(tree) if "\u0000" not in p] * 2
    rows = [(i, p, [None, None, True, False][i % 4], {"k": i}) for i, p in enumerate(paths)] + [(-1, None, None, None), (-2, None, True, None)]
    df = spark.createDataFrame(rows, "id long, p string, f boolean, more map<string,int>").repartition(5)
    got = probe_missing(df, "p", "f")
    assert got.columns == df.columns
    want = [(i, p, True if f or (p is not None and os.path.exists(p)) else None, m) for i, p, f, m in rows]
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert probe_missing(df.limit(0), "p", "f").collect() == []


def test_a_hot_folder_and_a_hot_path_are_split(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from pyspark.sql import functions as F
        rows = spark.range(8000).select(F.col("id").alias(_ROW), F.when(F.col("id") % 3 == 0, F.lit("/hot/one.png")).otherwise(
            F.concat(F.lit("/hot/"), F.col("id").cast("string"))).alias("p"))
        sizes = [r["count"] for r in by_folder(rows, "p", _ROW).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 7 and max(sizes) < 8000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
