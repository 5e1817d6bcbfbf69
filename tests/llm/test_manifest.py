"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import support
from cataloom.llm import merkle_manifest as mm
from cataloom.llm import queries

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3:i // 3 * 3 + 3]
        out.append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
        i //= 3
    return out


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        trees.append(_tree([_leaf(r, r[4]) for r in by[name]]))
    top = _tree([t[-1][0] for t in trees]) if trees else None
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(by[name]):
            path = _path(trees[k], i) + _path(top, k)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = _leaf(row, text)
            for place, others in path:
                node = _hash(*others[:place], node, *others[place:])
            root = top[-1][0]
            out.append((row[0], _leaf(row, row[4]), trees[k][-1][0], root, _hash(*[x for _, o in path for x in o]), node, node == root))
    return out


def awkward():
    """Sources of 1, 2, 3, 4, 81, 82 and 250 rows, a null and an empty one,
    names that only bytes put in order, repeated rows and ids, nulls anywhere."""
    rows = []
    for name, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("span", 81), ("over", 82), ("hot", 250), (None, 5), ("", 2), ("é", 2), ("z", 1), ("Z", 1)):
        rows += [(len(rows) * 7 % 1009 - 3, name, "en", 5, f"line {i}\nof {name}\n") for i in range(n)]
    rows += [(None, "one", None, None, None), (None, "one", None, None, ""), (5, "hot", None, 1, "a\nb"), (5, "hot", None, 1, "a\nb"), (5, "hot", "de", 1, "ab"), (8, None, None, None, "x" * 100_000 + "\n")]
    return rows


def _query(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return queries.op11_merkle_manifest(spark, "")


def test_against_plain_trees(spark, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame(rows, FIELDS).repartition(5).withColumns(
        {c: F.lit(f"extra {c}") for c in ("tree", "pos", "digest", "row", "at", "first", "depth", "path", "node", "bent", "leaf", "root", "j", "s0")})
    support.same(_query(spark, monkeypatch, docs), plain(rows), ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", None, None, "t"), (1, "b", None, None, "t")]])
def test_small_tables(spark, monkeypatch, rows):
    docs = spark.createDataFrame(rows, FIELDS)
    support.same(_query(spark, monkeypatch, docs), plain(rows), ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def test_only_every_few_levels_are_written(spark):
    made = mm.manifest(spark.createDataFrame([(i, "s", "en", 1, "t") for i in range(7000)], FIELDS))
    assert [x.count() for x in made.levels] == [7000, 87, 2, 1]
    assert made.sources.select("n_rows", "depth").collect() == [(7000, 9)]


def test_proofs_of_some_rows(spark):
    rows = awkward()
    made = mm.manifest(spark.createDataFrame(rows, FIELDS))
    asked = spark.createDataFrame([(5,), (rows[0][0],), (-99,), (None,)], "doc_id long")
    got = mm.proofs(made, asked).select("row.doc_id", "leaf", mm.proof_digest(F.col("path")), mm.fold(F.col("leaf"), F.col("path"))).collect()
    want = [(r[0], r[1], r[4], r[3]) for r in plain(rows) if r[0] in (5, rows[0][0])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_any_change_is_seen(spark):
    made = mm.manifest(spark.createDataFrame(awkward(), FIELDS))
    path, other = F.col("path"), F.sha2(F.col("leaf"), 256)
    assert mm.proofs(made).where((mm.fold(F.col("leaf"), path) != F.col("root")) | (mm.fold(other, path) == F.col("root"))).count() == 0
