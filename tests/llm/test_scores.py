"""N-best segmentation with a model whose scores have fractions."""

import numpy as np
import pytest

import support
from cataloom.llm.sentencepiece_nbest import MODEL, Lattice, _fixed, encode_nbest, vocabulary

TEXTS = ["the cat sat on the mat", "internationalization of things", "Der eingestellte Wagen", "naive resume (ok).", "-" * 100]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The production pieces as a unigram model, with log probabilities."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, piece in enumerate(model.pieces):
        piece.score = -3.71 - 8 * (i / len(model.pieces)) - 0.013 * (i % 7)
    path = str(tmp_path_factory.mktemp("model") / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path


def test_fractions_count(spark, unigram):
    import sentencepiece as spm

    theirs = spm.SentencePieceProcessor(model_file=unigram)
    got = {r.doc_id: r for r in encode_nbest(support.frame(spark, list(enumerate(TEXTS))), model=unigram).collect()}
    for i, text in enumerate(TEXTS):
        said = [sum(theirs.get_score(k) for k in ids) for ids in got[i].ids]
        assert got[i].scores == pytest.approx(said, abs=1e-9) and got[i].n_found == 4 and got[i].round_trip
        best = theirs.nbest_encode_as_ids(text, 4)
        assert got[i].scores == pytest.approx([sum(theirs.get_score(k) for k in ids) for ids in best], abs=1e-4)
        if len(text) < 100:  # no equal scores
            assert got[i].ids[0] == best[0]


def test_scores_are_kept(unigram):
    lattice, pieces = Lattice(vocabulary(unigram)), vocabulary(unigram)
    assert (lattice.score / lattice.scale == [s for _, s, _ in pieces]).all() and lattice.scale > 1
    whole = Lattice(vocabulary())
    assert whole.scale == 1 and (whole.score == [s for _, s, _ in vocabulary()]).all()
    score, scale = _fixed([-1e9, -0.5, 0.0, -3.25])
    assert np.array_equal(score / scale, [-1e9, -0.5, 0.0, -3.25])
    for scores in ([float("nan")], [-1e9, -3.71]):
        with pytest.raises(ValueError):
            _fixed(scores)
