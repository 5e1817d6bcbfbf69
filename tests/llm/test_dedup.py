"""Exact, near, substring and line dedup against plain versions."""

import random

import pytest

import support
from cataloom.llm.exact_dedup import exact_dedup
from cataloom.llm.line_windows import line_dedup
from cataloom.llm.near_dedup import near_dedup
from cataloom.llm.substring_dedup import _SUSPECT, _gather, _open_windows, substring_dedup

EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
CUT = ["doc_id", "n_words", "n_removed", "kept_sha256"]
LINES = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


def near(rows):
    reach = support.components(rows)
    return [(i, len(support.shingles(t)), reach.get(i), i is not None and reach[i] == i) for i, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_rows(spark, seed):
    rows = support.awkward(seed)
    docs = support.frame(spark, rows)
    support.same(exact_dedup(docs), support.exact(rows), EXACT)
    support.same(substring_dedup(docs), support.without_repeats(rows), CUT)
    support.same(line_dedup(docs), support.without_lines(rows), LINES)
    support.same(near_dedup(docs), near(rows), NEAR)


def test_empty_table(spark):
    docs = support.frame(spark, [])
    for operator, columns in ((exact_dedup, EXACT), (substring_dedup, CUT), (line_dedup, LINES), (near_dedup, NEAR)):
        assert operator(docs).select(*columns).collect() == []


def test_only_nulls(spark):
    rows = [(None, None), (1, None), (2, ""), (None, "a b c d e f")]
    docs = support.frame(spark, rows)
    support.same(exact_dedup(docs), support.exact(rows), EXACT)
    support.same(substring_dedup(docs), support.without_repeats(rows), CUT)
    support.same(line_dedup(docs), support.without_lines(rows), LINES)
    support.same(near_dedup(docs), near(rows), NEAR)


def test_kept_texts(spark):
    """The real output: what stays of each text."""
    rows = [(1, " ".join(f"a{i}" for i in range(20))), (2, "new " + " ".join(f"a{i}" for i in range(20)) + " end"), (3, "x\ny\nz"), (4, "h\nx\ny\nz\nt")]
    docs = support.frame(spark, rows)
    assert {r.doc_id: r.kept_text for r in substring_dedup(docs).where("n_removed > 0").collect()} == {2: "new end"}
    assert {r.doc_id: r.kept_text for r in line_dedup(docs).collect()}[4] == "h\nt"


def test_hot_groups(spark):
    """Most rows in one group of copies, one of near copies and one passage."""
    rng = random.Random(5)
    copy, base, passage = support.sentence(rng, 60), support.sentence(rng, 90).split(), support.sentence(rng, 30)
    rows = [(i, copy) for i in range(150)] + [(1000 + i, f"{passage} {support.sentence(rng, 20)}") for i in range(120)]
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(90)] = f"e{rng.randrange(50)}"
        rows.append((2000 + i, " ".join(own)))
    docs = support.frame(spark, rows)
    support.same(exact_dedup(docs), support.exact(rows), EXACT)
    support.same(substring_dedup(docs), support.without_repeats(rows), CUT)
    support.same(near_dedup(docs), near(rows), NEAR)


def test_blocks_and_skipped_lists(spark, monkeypatch):
    """The same result when lists and groups are cut into many blocks."""
    from cataloom.llm import near_dedup as module

    rng = random.Random(9)
    base = support.sentence(rng, 80).split()
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(3, 9)):
            own[rng.randrange(80)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(module, "BLOCK", 7)
    support.same(near_dedup(support.frame(spark, rows)), near(rows), NEAR)


def test_suspects_travel_compressed(spark):
    """Parts of documents with shared windows take less room than their texts, which come back unchanged."""
    text = " ".join(f"wörd{i % 97} other{i % 89}" for i in range(3000))
    rows = [(i, b"\xff" * 2000, f"{i} {text}") for i in range(40)] + [(40, b"\xff", "")]
    docs = spark.createDataFrame(rows, "doc_id long, flags binary, text string").coalesce(1)
    parts = [r.asDict() for r in docs.mapInArrow(_gather, "part long, ids array<long>, flags array<binary>, ends array<long>, texts binary").collect()]
    assert list(parts[0]) == _SUSPECT.names
    assert sum(len(p["texts"]) for p in parts) * 4 < sum(len(t.encode()) for *_, t in rows)
    for part in parts:
        w = _open_windows(part)[0]
        assert [bytes(w.data[a:b]).decode() for a, b in zip(part["ends"], part["ends"][1:])] == [rows[i][2] for i in part["ids"]]
