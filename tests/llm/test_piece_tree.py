"""Units scored along the tree of the pieces, and texts of a chunk encoded together."""

import random

import numpy as np
import pytest

from cataloom.llm import sentencepiece_nbest as nbest
from cataloom.llm.sentencepiece_nbest import Lattice, vocabulary
from test_sentencepiece import TEXTS, all_scores, encoded


@pytest.fixture
def lattice():
    return Lattice(vocabulary())


def test_what_begins_no_piece_is_not_followed(lattice, monkeypatch):
    """Names are looked up as far as pieces go, not for all parts of a unit."""
    rng, asked = random.Random(3), []
    units = {" " + "".join(rng.choice("theinganerstouzqxj") for _ in range(23)) for _ in range(500)}
    begins = {p[:k] for p in lattice.id_of for k in range(1, len(p) + 1)}
    ways = sum(1 for unit in units for start in range(24) for end in range(start + 1, 25) if unit[start:end] in begins)
    look_up = Lattice._look_up
    monkeypatch.setattr(Lattice, "_look_up", lambda self, names: asked.append(len(names)) or look_up(self, names))
    lattice.learn(units)
    assert sum(asked) <= ways + 24 * len(units)
    for unit in units:
        assert lattice.best[lattice.known[unit]] == lattice.forward(unit)[-1]


@pytest.mark.parametrize("remembered", [3, 250_000])
@pytest.mark.parametrize("n", [1, 4])
def test_texts_of_a_chunk(lattice, monkeypatch, remembered, n):
    """Whole segmentations of texts, empty ones among them, are those of each
    text alone, whatever was forgotten in between."""
    monkeypatch.setattr(nbest, "_REMEMBERED", remembered)
    texts = ["", *TEXTS, "", "a\x00b \x00", "=" * 70 + " x", *TEXTS[:3], ""]
    alone = Lattice(vocabulary())
    for own in (texts, texts[3:], texts[:1], []):
        got = list(lattice.segmentations(list(map(lattice.units_of, own)), n))
        assert len(got) == len(own)
        for text, found in zip(own, got):
            if not text:
                assert found == [(0, b"")]
                continue
            assert [s for s, _ in found] == all_scores(lattice, text)[:n]
            assert len({ids for _, ids in found}) == len(found)
            assert all(lattice.decode(np.frombuffer(ids, "<i4")) == text for _, ids in found)
            assert [(s, ids.tobytes()) for s, ids in encoded(alone, text, n)] == found


def test_nodes_that_meet_in_a_slot(monkeypatch):
    """With far fewer slots than nodes, pieces are still told apart."""
    monkeypatch.setattr(nbest, "_SLOTS", 9)
    lattice = Lattice(vocabulary())
    assert lattice._look_up(lattice._keys(list(lattice.id_of))).tolist() == list(lattice.id_of.values())
    assert lattice._look_up(lattice._keys(["qzxqzx", "\U00010428", "▁"])).tolist() == [-1] * 3
