"""The helpers: codes, exchange, components, names of words."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cataloom.llm import exchange, graph
from cataloom.llm.substring_dedup import representatives
from cataloom.llm.words import Words, windows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.integers(1, 2**64))
def test_golomb_round_trip(values, span):
    gaps = np.array(values, np.uint64) >> np.uint64(44)  # quotients stay short
    r, unary, low = exchange.golomb(gaps, min(span, 2.0**30))
    assert (exchange.ungolomb(len(gaps), r, unary, low) == gaps).all()


def test_numbers_round_trip():
    for x in ([5], [0, 255], [-7, 300], [0, 2**40], [-(2**63), 2**63 - 1]):
        a = np.array(x, np.int64)
        assert (exchange._unnumbers(exchange._numbers(a)) == a).all()


def test_exchange_answers(spark):
    rng = random.Random(3)
    lists = {p: sorted({rng.randrange(1 << 48) if rng.random() < 0.6 else rng.randrange(50) << 40 for _ in range(200)}) for p in range(6)}
    first = {p: [rng.randrange(1000) for _ in keys] for p, keys in lists.items()}
    rows = [(p, bytearray(np.array(k, np.uint64).tobytes()), bytearray(np.array(first[p], np.int64).tobytes())) for p, k in lists.items()]
    parts = spark.createDataFrame(rows, "part long, keys binary, firsts binary")
    for earlier in (False, True):
        said = {r["part"]: exchange.answer_bits(r["answers"]) for r in exchange.ask(parts, 48, 1200, earlier).collect()}
        for p, keys in lists.items():
            for i, k in enumerate(keys):
                others = [first[q][lists[q].index(k)] for q in lists if q != p and k in lists[q]]
                assert bool(said[p][i]) == (any(x < first[p][i] for x in others) if earlier else bool(others))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def _words(texts):
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n\x0b\x1c ", max_size=30), min_size=1, max_size=6))
def test_words_are_those_of_bytes_split(texts):
    w = _words(texts)
    want = [t.encode().split() for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for own in want for x in own]
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == flat
    names = {}
    for word, name in zip(flat, w.name.tolist()):
        assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_equal_windows_have_equal_representatives(seed):
    rng = random.Random(seed)
    passage = " ".join(rng.choice("abc") if rng.random() < 0.7 else "a" for _ in range(rng.randrange(13, 40)))
    texts = [" ".join(["q", *rng.choices("abcd", k=rng.randrange(6)), passage, *rng.choices("abcd", k=rng.randrange(6))]) for _ in range(3)] + [passage]
    w = _words(texts)
    starts, keys = representatives(w)
    named, whole = {}, windows(w.name, 13)
    for s, k in zip(starts.tolist(), keys.tolist()):
        assert named.setdefault(int(whole[s]), k) == k


def test_long_words():
    assert len(set(_words(["x" * 600_000 + " y", "x" * 600_001, "x" * 600_000]).name.tolist())) == 3
