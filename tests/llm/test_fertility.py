"""Fertility measures word by word in plain Python, and the bands."""

import base64
import collections
import math
import os
import random

import pytest
from pyspark.sql import functions as F

import support
from cataloom.llm import fertility as ft


def _coders():
    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(ft.FOLDER, ft.VOCABULARIES[0]))
    with open(os.path.join(ft.FOLDER, ft.VOCABULARIES[1]), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("plain", pat_str=ft.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def broken(token):
        return "�" in coder.decode([token]) and not coder.decode([token]).replace("�", "").strip()

    return (lambda w: model.encode(w), model.is_byte), (lambda w: coder.encode_ordinary(" " + w), broken)


def plain(text, coders, seen={}):
    words = [w.decode() for w in support.words(text)]
    lines, again, repeated = set(), 0, set()
    for line in (text or "").split("\n"):
        again += line in lines and bool(line.encode().split())
        lines.add(line)
    grams = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    for i in range(len(words) - 4):
        if grams[tuple(words[i:i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    out = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)]
    for k, (encode, lone) in enumerate(coders):
        tokens = collections.Counter()
        for w in words:
            tokens.update(seen.setdefault((k, w), encode(w)))
        n = sum(tokens.values())
        entropy = -sum(c / n * math.log2(c / n) for c in tokens.values())
        out += [n, out[1] / max(1, n), sum(c for t, c in tokens.items() if lone(t)) / max(1, n), entropy]
    return out


def awkward():
    rng = random.Random(2)
    rows = [(i, t, "en") for i, t in support.awkward()]
    rows += [(400, "▁ a▁b ▁▁ c d 　 e f ﻿ g", None), (401, "日本語 の テキスト を 数え ます か 。 は い", None), (402, "слово за слово и ещё одно слово 🙂🙂 \U0001f600", "ru"),
             (403, "don't <b> #1 $5 & 7% | x*y > 3 'll", None), (404, "x" * 30_000, None), (405, "dup\n\n \n \ndup\ndup \nDup\n\n", None), (406, "a b c d e f a b c d e g h", "en"),
             (407, "\x00 \x7f \x1f a\x85b", None)]
    rows += [(500 + i, support.sentence(rng, rng.randrange(40, 120)), "en") for i in range(300)]
    return rows


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = [f"{m}_{k}" for k in (0, 1) for m in ("tokens", "chars_per_token", "byte_share", "entropy")]


@pytest.fixture(scope="module")
def judged(spark):
    docs = support.frame(spark, awkward(), "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("script", "outside", "b_lang", "of_lang", "tokens_0")})
    rows = ft.quality(docs).collect()
    return {k: [r for r in rows if r.doc_id == k] for k in {r[0] for r in awkward()}}


def test_measures(judged):
    coders = _coders()
    for key, rows in judged.items():
        want = sorted([plain(t, coders) for i, t, _ in awkward() if i == key])
        got = sorted([[r[c] for c in COUNTS + MEASURED] for r in rows])
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a == pytest.approx(b, abs=1e-4), key


def test_scripts(judged):
    script = lambda key: judged[key][0].script
    assert (script(401), script(402), script(403), script(320), script(404)) == ("HIRAGANA", "CYRILLIC", "LATIN", None, "LATIN")


def test_verdicts(judged):
    for rows in judged.values():
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and not r.outside)
    usual = [r for k in range(500, 800) for r in judged[k]]
    assert sum(r.kept for r in usual) >= 297
    assert judged[320][0].base_failed and judged[321][0].base_failed


def test_bands_are_quartiles_of_all_rows(spark):
    rows = [(float(i), "en" if i % 2 else None) for i in range(200)]
    measured = spark.createDataFrame(rows, "x double, lang string").select(
        "lang", F.lit("LATIN").alias("script"), F.lit(20).cast("long").alias("n_words"), F.lit(16).cast("long").alias("tokens_0"),
        F.col("x").alias("chars_per_token_0"), F.lit(0.0).alias("byte_share_0"), F.lit(1.0).alias("entropy_0"))
    got = {(r.by, r.group, r.measure): (r.low, r.high, r.octave) for r in ft.bands(measured, 1, width=1.0).collect()}
    step = 200  # steps of chars_per_token in one
    assert got["script", "LATIN", "chars_per_token"] == ((49 - 100) * step, (149 + 100) * step, 4)
    assert got["lang", "en", "chars_per_token"] == ((49 - 100) * step, (149 + 100) * step, 4)
    assert got["script", "LATIN", "byte_share"] == (None, 50, 4)
    assert got["script", "LATIN", "entropy"] == (70, 160, 4) and ("lang", None, "entropy") not in got


def test_odd_texts_are_rejected(spark):
    rng = random.Random(4)
    usual = [(i, support.sentence(rng, rng.randrange(60, 100), 2000), "en") for i in range(400)]
    odd = [(1000, " ".join("".join(rng.choice("日本語テキスト") for _ in range(3)) for _ in range(80)), "en"),
           (1001, " ".join(f"{rng.randrange(10**9)}$$%%##" for _ in range(80)), "en"), (1002, " ".join(rng.choice(["a1", "b2"]) for _ in range(80)), "en")]
    got = {r.doc_id: r for r in ft.quality(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i].kept for i, *_ in odd) and sum(got[i].kept for i, *_ in usual) >= 396


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ft.quality(docs).collect() == []
