"""N-best segmentation of long runs, whose equal paths are without number."""

import pytest

import support
from cataloom.llm.sentencepiece_nbest import Lattice, decode, encode_nbest, vocabulary
from test_sentencepiece import all_scores, encoded


@pytest.fixture(scope="module")
def lattice():
    return Lattice(vocabulary())


@pytest.mark.parametrize("text", [" " * 513, " " * 1000, "#" * 301, "#" * 1003, " " + "-" * 1000, "ab " + "=" * 777 + "\n" + " " * 640 + "end"])
@pytest.mark.parametrize("n", [1, 4, 7])
def test_runs_have_the_best_scores(lattice, text, n):
    got = encoded(lattice, text, n)
    assert [s for s, _ in got] == all_scores(lattice, text)[:n]
    assert len({x.tobytes() for _, x in got}) == n
    assert all(lattice.decode(ids) == text for _, ids in got)


@pytest.mark.parametrize("c", " #-")
def test_very_long_runs(lattice, c):
    text = c * 100_000
    got = encoded(lattice, text, 2)
    assert got[0][0] == sum(lattice.forward(u)[-1] for u in lattice.units_of(text))
    assert len({x.tobytes() for _, x in got}) == 2
    for score, ids in got:
        assert lattice.decode(ids) == text and score == int(lattice.score[ids].sum())


def test_rows_with_runs(spark):
    rows = [(1, "a " + "-" * 3000 + " b"), (2, " " * 1000), (3, "#" * 1003), (4, "no run")]
    got = encode_nbest(support.frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_found, r.round_trip) for r in got} == {(i, 4, True) for i, _ in rows}
    back = decode(spark.createDataFrame([(r.doc_id, r.ids[3]) for r in got], "doc_id long, ids array<int>")).collect()
    assert sorted(map(tuple, back)) == rows
