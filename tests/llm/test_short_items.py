"""Benchmark items of one to four words."""

import re

import corpus_pipeline
import support
from cataloom.llm.decontaminate import short_items
from test_native import lower_words

ITEMS = [(1, "Forty two"), (2, "the  quick\tbrown fox"), (3, "xyzzy"), (4, "one two three"), (5, "xyzzy"), (6, None), (7, " \n"), (None, "a b"), (1, "forty two"), (8, "w1 w2 w3 w4 w5")]
DOCS = [(1, "it is FORTY\n two."), (2, "it is forty two"), (3, "The quick brown fox"), (4, "the quick brown"), (5, "say xyzzy xyzzy now"), (6, "one two four three"),
        (7, "one one two three"), (8, None), (9, ""), (None, "xyzzy"), (10, "c a b"), (10, "a c b"), (10, "c a b"), (11, "two"), (12, "xyzzyx " * 3), (13, "0 w1 w2 w3 w4 w5 6")]


def held(docs, items):
    out = set()
    for i, t in docs:
        for j, b in items:
            w, own = lower_words(t), lower_words(b)
            if 0 < len(own) < 5 and any(w[k:k + len(own)] == own for k in range(len(w))):
                out.add((i, t, j))
    return out


def test_short_items(spark):
    items = support.frame(spark, ITEMS, "item_id long, text string")
    want = held(DOCS, ITEMS)
    assert {i for i, _, _ in want} == {2, 3, 5, 7, 10, None}
    got = short_items(support.frame(spark, DOCS), items)
    support.same(got, list({(i, j) for i, _, j in want}), ["doc_id", "item_id"])
    assert not re.search("Python|Pandas|MapInArrow", got._jdf.queryExecution().executedPlan().toString())
    assert short_items(support.frame(spark, []), items).collect() == []
    assert short_items(support.frame(spark, DOCS), items.where("item_id = 8")).collect() == []


def test_documents_with_short_items_go(spark, tmp_path):
    support.frame(spark, ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = support.frame(spark, DOCS)
    got = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    bad = {(i, t) for i, t, _ in held(DOCS, ITEMS)} | {(13, DOCS[-1][1])}
    assert got.columns == docs.columns
    support.same(got, [row for row in DOCS if row not in bad], ["doc_id", "text"])
