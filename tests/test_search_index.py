"""Search by the trigram index equals the scan, and reads candidates only."""

import random

import pytest
from pyspark.sql import functions as F

from cataloom.operators import search_index as si
from cataloom.operators.joins import measured, scratch_folder
from cataloom.operators.search import search
from plan_util import plan_text

SCHEMA = "id int, name string, class string, prompt string, file_name string, more string"
ODD = ["é", "É", "é", "ß", "ẞ", "ø", "ﬁ", "ﬃ", "æ", "œ", "ŉ", "½", "…", " ", "​", "\x01", "한국", "한", "\U00010400", "я", "日", "ａ", "ı", "İ", "ſ", "K"]


def rows(n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["a", "b", "E", "s", "f", "i", "n", "1", *([rng.choice(ODD)] if rng.random() < 0.4 else ["x"])]) for _ in range(rng.randrange(1, 6)))
    out = [(i * 37, word(), rng.choice(["photo", "Photo", None]), " ".join(word() for _ in range(rng.randrange(0, 30))), f"{i}.png", "x") for i in range(n)]
    return out + [(5, None, None, None, None, None), (7, "", "", "", "", ""), (7, "again", "photo", "Straße nach Łódź", "7.png", ""),
                  (40_000_000, "far", "photo", "the far end " * 3000, "z.png", ""), (-3, "below", "photo", "below zero", "-3.png", "")]


@pytest.fixture(scope="module")
def indexed(spark):
    catalog = measured(spark.createDataFrame(rows(), SCHEMA).repartition(4))
    return catalog, si.SearchIndex.build(catalog, scratch_folder(spark, "search_index"))


TERMS = [{"prompt": t} for t in ("a", "ab", "abx", "ABX", "ess", "eßs", "strasse", "STRAẞE nach", "lodz", "ﬁn", "fin", "ffi", "a_b", "ab%ba", "%%", "_", "xx\\%", "\x01abx", "한국",
                                 "far end the", "no such thing", "1ab é", "aab x", "oef", "nbe", "a" * 70)]
TERMS += [{"name": "aga", "class_": "PHOTO"}, {"file_name": ".pn", "name": "ab"}, {"file_name": "7.png"}, {"name": "  ", "prompt": "zero"}, {"prompt": None}, {"name": "far", "prompt": "the far"}]


@pytest.mark.parametrize("named", [si.NAMED_IDS, 0])
def test_equals_the_scan(indexed, monkeypatch, named):
    monkeypatch.setattr(si, "NAMED_IDS", named)
    catalog, index = indexed
    for terms in TERMS if named else TERMS[2:8]:
        for collation in ("insensitive", "binary"):
            want = sorted(map(tuple, search(catalog, collation=collation, **terms).collect()), key=repr)
            assert sorted(map(tuple, index.search(catalog, collation=collation, **terms).collect()), key=repr) == want, (terms, collation)


def test_reads_candidates_only(indexed):
    catalog, index = indexed
    found = index.search(catalog, prompt="below zero")
    assert "In(id, [" in plan_text(found) and index.candidates({"prompt": "below zero"}).count() <= 1 + index.odd.distinct().count()
    lists = plan_text(index.candidates({"prompt": "zero"}))
    assert "In(gram" in lists and "EqualTo(field" in lists


def test_short_terms_scan(indexed):
    catalog, index = indexed
    assert index.candidates({"prompt": "ab"}) is None and index.candidates({"prompt": "a%b_c"}) is None and index.candidates({}) is None


def test_hot_trigrams_are_split_by_block(spark):
    many = spark.range(30_000).select(F.col("id").cast("int").alias("id"), F.lit("same").alias("name"), F.lit("c").alias("class"), F.lit("the same text").alias("prompt"), F.lit("f").alias("file_name"))
    index = si.SearchIndex.build(many, scratch_folder(spark, "search_index"))
    assert index.postings.agg(F.max("n")).first()[0] <= si.BLOCK_IDS
    assert index.search(many, name="SAM", prompt="same text").count() == 30_000


def test_empty_catalog(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = si.SearchIndex.build(empty, scratch_folder(spark, "search_index"))
    assert index.search(empty, prompt="abc").collect() == []
