"""Search semantics: blank terms, wildcards, NULLs, collations."""

import pytest
from pyspark.sql import functions as F

from cataloom.operators.search import as_json_rows, display_rows, distinct_first, search


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(1, "Élan vital", "Photo", "Une île déserte", "D:\\r\\a.png", "a.png"),
            (2, "elan", "photo", "the 50% rule", "D:\\r\\b.png", "b.png"),
            (3, None, "paint", "ÉTUDE no. 5", "D:\\r\\c.png", "c.png"),
            (4, "x_y", None, None, "D:\\r\\d.png", "d.png")]
    return spark.createDataFrame(rows, "id int, name string, class string, prompt string, origin_path string, "
                                       "file_name string")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_no_terms_returns_everything_with_img_exist(catalog):
    out = search(catalog)
    assert ids(out) == [1, 2, 3, 4]
    assert {r["img_exist"] for r in out.collect()} == {1}


def test_blank_terms_add_nothing(catalog):
    assert ids(search(catalog, name="  ", class_="\t", prompt="")) == [1, 2, 3, 4]


def test_case_and_accent_insensitive_by_default(catalog):
    assert ids(search(catalog, name="ELAN")) == [1, 2]
    assert ids(search(catalog, prompt="etude")) == [3]
    assert ids(search(catalog, prompt="ILE")) == [1]


def test_null_column_never_matches(catalog):
    assert ids(search(catalog, name="a")) == [1, 2]
    assert ids(search(catalog, class_="o")) == [1, 2]


def test_binary_collation_is_exact(catalog):
    assert ids(search(catalog, name="elan", collation="binary")) == [2]
    assert ids(search(catalog, name="Élan", collation="binary")) == [1]


def test_wildcards_stay_wildcards(catalog):
    # "_" matches any one character, "%" any run, in both collations
    assert ids(search(catalog, name="x_y")) == [4]
    assert ids(search(catalog, name="e_an")) == [1, 2]
    assert ids(search(catalog, prompt="50%rule")) == [2]
    assert ids(search(catalog, prompt="une%DESERTE")) == [1]
    assert ids(search(catalog, name="E_A", collation="binary")) == []
    assert ids(search(catalog, name="e_an", collation="binary")) == [2]


def test_escaped_wildcards_are_literal(catalog):
    assert ids(search(catalog, prompt="50\\%")) == [2]
    assert ids(search(catalog, name="x\\_y")) == [4]
    assert ids(search(catalog, name="e\\_an")) == []


def test_conjunction_of_fields(catalog):
    assert ids(search(catalog, name="elan", class_="PHOTO", file_name="b")) == [2]


def test_display_rows_and_json(catalog):
    with_target = catalog.withColumn("target_path", F.lit(None).cast("string"))
    shown = {r["id"]: r for r in display_rows(with_target).collect()}
    assert shown[3]["name"] == "" and shown[4]["class"] == "" and shown[4]["prompt"] == ""
    js = as_json_rows(catalog.where("id >= 2 and id <= 3").select("id", "name")).collect()
    assert {r[0] for r in js} == {'{"id":2,"name":"elan"}', '{"id":3,"name":null}'}


def test_distinct_first(catalog):
    out = {r["class"]: r["first_id"] for r in distinct_first(catalog, ["class"], "id").collect()}
    assert out == {"Photo": 1, "photo": 2, "paint": 3, None: 4}
