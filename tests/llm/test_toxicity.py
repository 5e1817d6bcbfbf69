"""Held-out accuracy, what may be learnt from, and the label model."""

import random
import zlib

import numpy as np

import support
from cataloom.llm.toxicity import label_model, score_toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700, seed=8):
    rng = random.Random(seed)
    rude = ["scoundrel", "nitwitted", "nitwittery", "blockhead", "vermin"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = support.sentence(rng, rng.randrange(5, 60)).split()
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(rude))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic) if rng.random() < 0.97 else 1 - int(toxic)))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_rows(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in score_toxicity(support.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == held_out(i) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5) for i, _ in rows)
    judged = [(got[i].predicted, y) for i, _, y in labels if held_out(i)]
    assert sum(p == y for p, y in judged) / len(judged) > 0.9


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    turned = [(i, q, 1 - y if held_out(i) else y) for i, q, y in labels]
    a, b = ({r.doc_id: round(r.score, 9) for r in score_toxicity(support.frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def test_awkward_rows(spark):
    rows, labels = corpus(200)
    rows = [(10_000 + i if i is not None else None, t) for i, t in support.awkward()] + rows
    labels += [(None, 1, 1), (10_001, None, None), (10_002, 1, 0), (10_002, 1, 1), (999_999, 1, 1)]
    got = score_toxicity(support.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert {r.predicted for r in got if r.doc_id in (10_320, 10_321)} == {0}
    copies = {(r.doc_id, r.score) for r in got if r.doc_id == 10_330}
    assert len(copies) == 1


def test_no_labels(spark):
    rows, labels = corpus(50)
    for own in ([], [(i, 1, 0) for i in range(20)]):
        got = score_toxicity(support.frame(spark, rows), spark.createDataFrame(own, LABELS)).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 50
    assert score_toxicity(support.frame(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def test_label_model_finds_rates_and_groups():
    rng = np.random.default_rng(1)
    n = 40_000
    y = rng.random(n) < 0.2
    hit, miss = [0.8, 0.6, 0.7, 0.5], [0.05, 0.1, 0.2, 0.02]
    bits = [np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in zip(hit, miss)]
    bits.append(np.where(rng.random(n) < 0.9, bits[2], ~bits[2]))  # leans on the third voter
    votes = sum(b.astype(np.int64) << i for i, b in enumerate(bits))
    label = np.where(rng.random(n) < 0.1, y.astype(int), -1)
    seen, times = np.unique(votes * 4 + label + 1, return_counts=True)
    model = label_model(seen // 4, seen % 4 - 1, times, 5)
    assert [2, 4] in model.groups and abs(model.prior - 0.2) < 0.02
    for v in (0, 1, 3):
        table = model.tables[model.groups.index([v])]
        assert abs(table[1, 1] - hit[v]) < 0.05 and abs(table[0, 1] - miss[v]) < 0.05
    post = model.posterior(votes, np.full(n, -1))
    assert ((post > 0.5) == y).mean() > 0.9


def test_a_text_is_learnt_from_once(spark, monkeypatch):
    """Rows that repeat an id, with other texts or the same one."""
    from cataloom.llm import toxicity

    seen = []

    class Spy(toxicity.LogisticRegression):
        def fit(self, rows):
            seen.append((rows.count(), rows.agg({"weight": "sum"}).first()[0]))
            return super().fit(rows)

    monkeypatch.setattr(toxicity, "LogisticRegression", Spy)
    monkeypatch.setattr(toxicity, "UNLABELLED_ROWS", 0)
    rows, labels = corpus(200)
    named = {i: y for i, _, y in labels if not held_out(i)}
    many = min(named)
    rows += [(many, f"another text number {k} under this id") for k in range(60)] + [(many, "one more, again and again")] * 40
    own = {t for i, t in rows if i in named}
    score_toxicity(support.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert seen[0][0] <= 2 * len(own) and abs(seen[0][1] - len(own)) < 1e-6


def test_unlabelled_texts_are_learnt_from_by_their_posterior(spark, monkeypatch):
    """Each text that no label may speak of, held-out ones among them, counts
    once, with the posterior that the label model gives to its votes."""
    from cataloom.llm import toxicity

    seen = []

    class Spy(toxicity.LogisticRegression):
        def fit(self, rows):
            seen.extend((r.label, r.weight) for r in rows.collect())
            return super().fit(rows)

    monkeypatch.setattr(toxicity, "LogisticRegression", Spy)
    rows, labels = corpus(200)
    rows += [(10_000 + k, "one text under many ids without a label") for k in range(30)] + [(None, "nobody's"), (None, "nobody's"), (10_100, None), (10_101, "")]
    named = {i for i, _, _ in labels if not held_out(i)}
    own = {t for i, t in rows if i in named}
    others = {t or "" for _, t in rows} - own
    got = {r.tag: r.posterior for r in score_toxicity(support.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    tags = {r.text: r.tag for r in spark.createDataFrame([(t,) for t in sorted(own | others)], "text string").selectExpr("text", "xxhash64(text) as tag").collect()}
    assert abs(sum(w for _, w in seen) - len(own) - toxicity.UNLABELLED_WEIGHT * len(others)) < 1e-6
    weak = sorted(w for y, w in seen if y == 1)
    for text in others:  # every one of them is there with its own weight
        want = toxicity.UNLABELLED_WEIGHT * got[tags[text]]
        at = min(range(len(weak)), key=lambda i: abs(weak[i] - want))
        assert abs(weak.pop(at) - want) < 1e-9
