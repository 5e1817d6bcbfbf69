"""N-best segmentation against all paths, the library and round trips."""

import gc
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import support
from cataloom.llm.sentencepiece_nbest import MODEL, Lattice, _encoder, decode, encode_nbest, vocabulary


@pytest.fixture(scope="module")
def lattice():
    return Lattice(vocabulary())


def all_scores(lattice, text):
    """Scores of all segmentations, by dynamic programming over lists."""
    s = " " + text
    found = [[0]] + [[] for _ in s]
    for end in range(1, len(s) + 1):
        for start, score, _ in lattice.edges(s, end):
            found[end] += [x + score for x in found[start]]
        found[end] = sorted(found[end], reverse=True)[:50]
    return found[-1]


def encoded(lattice, text, n):
    units = lattice.units_of(text)
    lattice.learn(set(units))
    paths, found = lattice.encode(units, n)
    out = []
    for score, changes in found:
        own = list(paths)
        for i, path in changes:
            own[i] = path
        out.append((score, np.frombuffer(b"".join(own), "<i4")))
    return out


TEXTS = ["the cat", "in the the end.", "zz qq\n\nété", "▁x y", "  a  b ", "日本語 text", "naïve—résumé (ok).", "aaaaaaa bbbbbbb", "\x00 ctl \x07", "😀😛 mix"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_scores_are_the_best_of_all_paths(lattice, text, n):
    got = encoded(lattice, text, n)
    assert [s for s, _ in got] == all_scores(lattice, text)[:n]
    assert len({x.tobytes() for _, x in got}) == len(got)
    for score, ids in got:
        assert lattice.decode(ids) == text
        assert score == sum(lattice.score[i] for i in ids if not pieces_are_bytes(lattice, i)) + unknown_cost(lattice, ids)


def pieces_are_bytes(lattice, i):
    return int(i) in set(lattice.byte_id.values())


def unknown_cost(lattice, ids):
    """A character spelt in bytes costs once: at its first byte."""
    value = {i: b for b, i in lattice.byte_id.items()}
    return sum(lattice.unknown for i in ids if int(i) in value and not 0x80 <= value[int(i)] < 0xC0)


def test_scalar_and_joint_paths_agree(lattice):
    rng = random.Random(2)
    for _ in range(150):
        unit = " " * rng.randrange(3) + "".join(rng.choice("theinganerstou.é|,") for _ in range(rng.randrange(1, 30)))
        for own in set(lattice.cut(unit)):
            lattice.learn({own})
            i, best = lattice.known[own], lattice.nbest(own, 2)
            assert lattice.best[i] == best[0][0]
            assert lattice.delta[i] == (best[0][0] - best[1][0] if len(best) > 1 else -1)


def test_the_library_agrees_on_the_n_best(lattice):
    """The same file read as a unigram model, whose lattice search gives N
    best segmentations, has the same scores."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    theirs = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["the cat sat on the mat", "internationalization of things", "Der eingestellte Wagen", "été, naïve"]:
        best = theirs.nbest_encode_as_ids(text, 4)
        assert [s for s, _ in encoded(lattice, text, 4)] == [sum(theirs.get_score(i) for i in ids) for ids in best]
        assert encoded(lattice, text, 1)[0][1].tolist() == best[0]


def test_awkward_rows(spark, lattice):
    rows = support.awkward()
    docs = support.frame(spark, rows)
    got = encode_nbest(docs, with_ids=2).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r in itertools.islice((x for x in got if x.n_pieces < 400), 60):
        assert r.scores == sorted(r.scores, reverse=True) and r.n_pieces == len(r.ids[0])
    back = decode(encode_nbest(docs).selectExpr("doc_id", "ids[0] AS ids")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in rows)
    assert {(r.n_pieces, r.n_found, tuple(r.scores)) for r in got if r.doc_id == 321} == {(0, 1, (0.0,))}


def test_empty_table(spark):
    assert encode_nbest(support.frame(spark, [])).collect() == []


def test_a_worker_keeps_nothing_of_a_finished_task(lattice):
    """Idle Python workers stay beside the next stages' ones: what a task has learnt goes with it."""
    class Shared:
        value = vocabulary()

    alive = lambda: [o for o in gc.get_objects() if isinstance(o, Lattice) and o is not lattice]
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the cat", "in the end."]})
    before = len(alive())
    assert sum(b.num_rows for b in _encoder(Shared, 2, 1)([rows])) == 2
    gc.collect()
    assert len(alive()) == before


def test_names_of_pieces(lattice):
    """Every piece is found by its name, and no other text is."""
    pieces = list(lattice.id_of)
    assert lattice._look_up(lattice._keys(pieces)).tolist() == list(lattice.id_of.values())
    assert lattice._look_up(lattice._keys(["qzxqzx", "\U00010428", "▁"])).tolist() == [lattice.id_of.get(p, -1) for p in ("qzxqzx", "\U00010428", "▁")]
