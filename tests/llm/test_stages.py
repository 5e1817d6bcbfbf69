"""The pipeline's stages where they differ from the operators' contracts."""

import random

import corpus_pipeline
import support
from cataloom.llm.queries import QUERIES


def edited(rng, base, edits, mark):
    """A copy of ``base`` with ``edits`` words changed far apart: each takes five shingles."""
    own = list(base)
    for k in rng.sample(range(4, len(base) - 4, 6), edits):
        own[k] = f"{mark}x{k}"
    return " ".join(own)


def test_near_copies_from_80_percent_go(spark, sf_dir):
    rng = random.Random(12)
    rows = support.awkward(6)
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(204)]
        # of 200 shingles 5 * edits change: similarity 0.860, 0.818 or 0.778
        rows += [(1000 + 10 * g + i, t) for i, t in enumerate([" ".join(base), edited(rng, base, 3 + g % 3, f"g{g}"), f"own{g} " * 3 + "end"])]
    at_80, at_85 = support.components(rows, 80), support.components(rows, 85)
    assert sum(at_80[i] != at_85[i] for i in at_80) >= 10
    got = corpus_pipeline.drop_near_copies(spark, support.frame(spark, rows), sf_dir)
    support.same(got, [(i, t) for i, t in rows if i is None or at_80[i] == i], ["doc_id", "text"])


def test_stages_at_80_percent(spark, sf_dir):
    """Each stage from the exact copies on, with the near copies from 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    got = stage["exact_dedup"](spark, docs, sf_dir)
    keep = {i for i, k, *_ in support.exact(rows) if i == k}
    rows = [(i, t) for i, t in rows if i in keep]
    got = stage["near_dedup"](spark, got, sf_dir)
    reach = support.components(rows, 80)
    assert reach != support.components(rows, 85)
    rows = [(i, t) for i, t in rows if reach[i] == i]
    support.same(got, rows, ["doc_id", "text"])
    got = stage["decontamination"](spark, got, sf_dir)
    bad = {r.doc_id for r in QUERIES["op5_benchmark_containment"](spark, sf_dir).collect()}
    rows = [(i, t) for i, t in rows if i not in bad]
    support.same(got, rows, ["doc_id", "text"])
    assert {(r.doc_id, r.round_trip) for r in stage["sentencepiece"](spark, got, sf_dir).collect()} == {(i, True) for i, _ in rows}
