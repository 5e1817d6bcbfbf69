"""Column functions against plain-Python models of the reference behaviour."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cataloom.functions.paths import basename, dirname, image_path, path_join, replace_first
from cataloom.functions.text import COLLATION, _BASES, _collated, _collated_like, _near, blank, clean_escapes, contains_term, has_wildcard, like_regex, unescape

SEG = st.text(alphabet="abcXYZ._- é", min_size=1, max_size=6).filter(lambda s: s.strip(". ") != "")


def _eval(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(SEG, min_size=2, max_size=5), min_size=1, max_size=20))
def test_basename_dirname_of_joined_paths(spark, paths):
    joined = ["D:\\" + "\\".join(p) for p in paths]
    assert _eval(spark, joined, basename) == [p[-1] for p in paths]
    assert _eval(spark, joined, dirname) == ["D:\\" + "\\".join(p[:-1]) for p in paths]


def test_path_edge_cases(spark):
    cases = {"D:\\x.png": ("x.png", "D:\\"), "x.png": ("x.png", "."), "a/b\\c.txt": ("c.txt", "a/b"),
             "D:\\a\\b\\": ("b", "D:\\a"), "\\top": ("top", "\\")}
    got_base = _eval(spark, list(cases), basename)
    got_dir = _eval(spark, list(cases), dirname)
    assert got_base == [v[0] for v in cases.values()]
    assert got_dir == [v[1] for v in cases.values()]
    posix = _eval(spark, ["/srv/a/b.png", "/b.png"], lambda c: dirname(c, "posix"))
    assert posix == ["/srv/a", "/"]


def test_path_join(spark):
    df = spark.createDataFrame([("D:\\root\\", "\\images", "x.png")], "a string, b string, c string")
    assert df.select(path_join("a", "b", "c")).first()[0] == "D:\\root\\images\\x.png"
    assert df.select(path_join("a", "b", "c", style="posix")).first()[0] == "D:\\root\\/\\images/x.png"
    cases = {("/srv/public", "/images/a.png"): "/srv/public/images/a.png", ("/srv/./x//", "../y"): "/srv/y", ("/", "../.."): "/",
             ("a", "../../b"): "../b", ("/a/b", "./../../../c/."): "/c"}
    df = spark.createDataFrame(list(cases), "a string, b string")
    assert {(r.a, r.b): r.j for r in df.withColumn("j", path_join("a", "b", style="posix")).collect()} == cases


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab\\/", max_size=12), min_size=1, max_size=30),
       st.text(alphabet="ab\\", min_size=1, max_size=3), st.text(alphabet="xy\\", max_size=4))
def test_replace_first_is_first_occurrence_only(spark, values, old, new):
    got = _eval(spark, values, lambda c: replace_first(c, old, new))
    assert got == [v.replace(old, new, 1) for v in values]


def test_sort_number_is_never_truncated(spark):
    df = spark.createDataFrame([(12, 1000), (5, 3), (5, 0), (7, 123456)], "i int, s int")
    assert [r[0] for r in df.select(image_path("i", "s")).collect()] == \
        ["/images/img12_1000.png", "/images/img5_003.png", "/images/img5_000.png", "/images/img7_123456.png"]


def test_blank_matches_js_trim():
    assert blank(None) and blank("") and blank(" \t\n") and blank("\u00a0\u3000\ufeff")
    assert not blank(" a ") and not blank("%")


def test_clean_escapes():
    assert clean_escapes("a\\b") == "ab"
    assert clean_escapes("50\\%") == "50\\%"
    assert clean_escapes("x\\") == "x\\\\"
    assert has_wildcard("a_b") and has_wildcard("%") and not has_wildcard("a\\%b")


def _like_model(body, s):
    rx, i = "", 0
    while i < len(body):
        ch = body[i]
        if ch == "\\" and i + 1 < len(body):
            rx += re.escape(body[i + 1])
            i += 2
            continue
        rx += ".*" if ch == "%" else "." if ch == "_" else re.escape(ch)
        i += 1
    return re.fullmatch(rx, s, re.S) is not None


def test_like_regex_equals_like_in_spark(spark):
    rnd = random.Random(7)
    pairs = []
    for _ in range(3000):
        body = "".join(rnd.choice("ab%_.\\") for _ in range(rnd.randint(0, 6)))
        body = clean_escapes(body)
        text = "".join(rnd.choice("ab.\n%_") for _ in range(rnd.randint(0, 8)))
        pairs.append((like_regex(body), text, _like_model(body, text)))
    df = spark.createDataFrame(pairs, "rx string, t string, want boolean")
    bad = df.where(F.expr("t rlike rx") != F.col("want")).count()
    assert bad == 0


def test_whole_seconds_and_run_time(spark):
    from cataloom.functions.times import run_time, whole_seconds
    df = spark.createDataFrame([("2025-01-02 03:04:05.499",), ("2025-01-02 03:04:05.5",)], "v string")
    got = [str(r[0]) for r in df.select(whole_seconds(F.col("v").cast("timestamp"))).collect()]
    assert got == ["2025-01-02 03:04:05", "2025-01-02 03:04:06"]
    assert str(spark.range(1).select(run_time("2025-01-02 00:00:00")).first()[0]) == "2025-01-02 00:00:00"


_ALPHABET = ["a", "b", "e", "E", "é", "É", "è", "e\u0301", "ß", "s", "x", "i", "ø", "Ø", "o", "l", "ﬁ", "f", "\u200b", "K", "k", ".", "%", "_", "\\", "\n",
             "한", "국", "\u1112\u1161\u11ab", "\U00010400", "\U00010428", "日", "я", "Я", "й"]
# what the collation holds equal, for the characters above
_EQUAL = {"é": "e", "è": "e", "e\u0301": "e", "ß": "ss", "ø": "o", "ﬁ": "fi", "\u200b": "", "\u1112\u1161\u11ab": "한", "\U00010400": "\U00010428", "й": "и"}


def _classes(text):
    """What each character equals, without those that the collation ignores."""
    import regex
    return [x for u in regex.findall(r"\X", text) if (x := _EQUAL.get(u.lower(), _EQUAL.get(u, u.lower())))]


def _collated_model(body, text):
    """``text LIKE body`` by dynamic programming over characters; a character
    that equals several takes them all."""
    term, i = [], 0
    while i < len(body):
        if body[i] in "%_":
            term.append((body[i], ""))
        else:
            i += body[i] == "\\" and i + 1 < len(body)
            term += [("=", c) for x in _classes(body[i]) for c in x]
        i += 1
    chars = _classes(text)
    open_, done = {(0, 0)}, set()
    while open_:
        k, p = at = open_.pop()
        done.add(at)
        if k == len(term):
            continue
        more = set()
        if term[k][0] == "%":
            more |= {(k + 1, p)} | ({(k, p + 1)} if p < len(chars) else set())
        elif p < len(chars):
            n = 1 if term[k][0] == "_" else len(chars[p])
            if term[k][0] == "_" or term[k:k + n] == [("=", c) for c in chars[p]]:
                more.add((k + n, p + 1))
        open_ |= more - done
    return (len(term), len(chars)) in done


def test_wildcards_under_the_collation(spark):
    rnd = random.Random(11)
    singles = [c for c in _ALPHABET if len(c) == 1 and c != "\n"]
    texts = ["".join(rnd.choice(_ALPHABET) for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").cache()
    for _ in range(25):
        term = clean_escapes("".join(rnd.choice(["%", "_", rnd.choice(singles)]) for _ in range(rnd.randint(1, 4))) + "_")
        got = {r.id for r in df.where(contains_term("t", term)).collect()}
        assert got == {i for i, t in enumerate(texts) if _collated_model(f"%{term}%", t)}, term


def test_a_term_means_the_same_with_and_without_a_wildcard(spark):
    rnd = random.Random(13)
    texts = ["".join(rnd.choice(_ALPHABET) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    texts += ["Straße", "strasse", "Øl", "ol", "ﬁle", "file", "a\u200bb", "ab", "Kelvin", "한국어 문서", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").cache()
    for term in ["strasse", "ß", "ol", "ØL", "file", "ﬁ", "ab", "a\u200bb", "e", "É", "k", "ss", "\\%", "x\\_", "i", "한국", "\U00010428", "\U00010400", "Я", "й"]:
        plain, wild = ({r.id for r in df.where(contains_term("t", term + end)).collect()} for end in ("", "%"))
        assert plain == wild == {i for i, t in enumerate(texts) if t is not None and _collated_model(f"%{clean_escapes(term)}%", t)}, term


def test_a_long_term_with_wildcards(spark):
    """More characters than one number has bits."""
    df = spark.createDataFrame([(1, "é" + "ab" * 100 + "ç"), (2, "é" + "ab" * 99 + "ç"), (3, None)], "id int, t string")
    assert [r.id for r in df.where(contains_term("t", "E" + "aB" * 50 + "%" + "_b" * 50 + "C")).collect()] == [1]


def test_the_collation_is_asked_about_surroundings_only(spark):
    """Long runs of characters that it compares one by one are left out, and
    every term finds what it finds in the whole text."""
    rnd = random.Random(17)
    letters = ["a", "b", "S", "É", "ö", "ø", "ß", "æ", "한", "국", "щ", "е\u0308", "e\u0301", "語", "書", "\U00010428", " ", "|", "\r", "\u200d", "²", "\u0600"]
    texts = []
    for _ in range(600):
        own = rnd.sample(letters, rnd.randint(2, 8)) + ["a"] * rnd.choice([0, 20])
        texts.append("".join(rnd.choice(own) * rnd.choice([1, 1, 2, 12]) for _ in range(rnd.randint(0, 40))))
    texts += ["plain text " * 2000 + "한국어" + " und naïve Sätze" * 2000, "plain text " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").cache()
    c = F.col("t")
    kept = [len(r[0]) for r in df.where("id >= 600").orderBy("id").select(_near(c, 4, "|")).collect()]
    assert kept == [8 + 4 + 3 + 4 + 8, 12]
    for term in ["한국", "한_국", "語%書", "語_%_書", "ё", "a_b", "_a", "aab", "ss", "E", "oe", "ø", "|a", "a|b", "__", "_한", "\U00010400_", "a%書"]:
        whole = _collated_like(c, term) if has_wildcard(term) else F.contains(F.collate(c, COLLATION), F.lit(unescape(term)))
        assert df.where(~whole.eqNullSafe(_collated(c, term))).count() == 0, term


def test_bases_are_what_the_collation_holds_equal(spark):
    one = spark.createDataFrame(list(_BASES.items()), "c string, base string")
    two = one.select(F.col("c").alias("d"), F.col("base").alias("other"))
    assert one.crossJoin(two).where((F.collate("c", COLLATION) == F.collate("d", COLLATION)) != (F.col("base") == F.col("other"))).count() == 0
