"""Quality rules by the fertility of public tokenizers.

Every document is measured with each vocabulary: characters per token, share
of tokens that are lone bytes, entropy of the tokens. A document goes when a
measure lies outside the band of its language (its script where no language
is given) and length class. Bands are quartiles of all documents, widened.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterable
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.spelt_words import SpeltWords
from cataloom.llm.tables import stored
from cataloom.llm.words import chunks

#: Public vocabularies: a sentencepiece model, and ranks of a byte-level BPE.
FOLDER = "/opt/tokenizers"
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: Fixed value: the public pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The band: quartiles widened by so many of their distances on either side,
#: and by the floor of a measure at least.
WIDTH = 2.5
#: Per measure: step in which it is counted, least widening in steps, its
#: multiples below and above (0: no bound; many distinct words are no fault
#: until far above what is usual).
MEASURES = {"chars_per_token": (0.005, 20, 1, 1), "byte_share": (0.001, 50, 0, 1), "entropy": (0.01, 30, 1, 2)}
#: Documents that a band stands on at least; with fewer, the script's band is
#: taken, then none. Texts of fewer words are left to the base rules.
LEAST_GROUP, LEAST_WORDS = 50, 10
#: Base rules: words at least, and percent of words in repeated windows at most.
BASE_WORDS, BASE_REPEATS, WINDOW = 10, 20, 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Bytes of text measured at a time, and words given to a tokenizer as one text.
_BYTES, _TOGETHER = 8 << 20, 2000
_FINE = 1 << 16


class Vocabulary:
    """Tokens of single words, each after a blank."""

    def __init__(self, name: str, content: bytes):
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.begins = np.array([p.startswith("▁") for p in pieces])
            self.lone = np.array([model.is_byte(i) for i in range(len(pieces))])
            self._many = lambda texts: model.encode(texts, num_threads=1)
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            coder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            spelt = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                spelt[rank] = token
            self.begins = np.array([t.startswith(b" ") for t in spelt])
            self.lone = np.array([_broken(t) for t in spelt])
            self._many = lambda texts: [coder.encode_ordinary(" " + t) for t in texts]

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, index of each word's first one, with the
        total at the end). A word's tokens depend on nothing outside it."""
        ids, first, total = [], [], 0
        for lo in range(0, len(words), _TOGETHER):
            own = words[lo:lo + _TOGETHER]
            got = np.array(self._many([" ".join(own)])[0], np.int64)
            starts = np.flatnonzero(self.begins[got])
            if len(starts) != len(own):  # a word that holds a blank mark, or a blank of its own
                apart = [np.array(x, np.int64) for x in self._many(own)]
                got, starts = np.concatenate(apart), np.cumsum([0, *map(len, apart)])[:-1]
            ids.append(got)
            first.append(starts + total)
            total += len(got)
        return np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate([*first, [total]]).astype(np.int64)


def _broken(token: bytes) -> bool:
    """A token that holds no whole character."""
    try:
        token.decode()
        return False
    except UnicodeDecodeError:
        return not token.decode("utf-8", "ignore").strip()


def contents(folder: str = FOLDER, names: Iterable[str] = VOCABULARIES) -> tuple[tuple[str, bytes], ...]:
    """Vocabulary files as (name, bytes): a few megabytes, of a size that no data changes."""
    out = []
    for name in names:
        with open(os.path.join(folder, name), "rb") as f:
            out.append((name, f.read()))
    return tuple(out)


@lru_cache(maxsize=1)  # a Python worker outlives its query
def _worker(files) -> list[Vocabulary]:
    return [Vocabulary(name, content) for name, content in files.value]


@cache
def _script(code: int) -> str | None:
    """The script of a letter: the first word of its Unicode name."""
    char = chr(code)
    return unicodedata.name(char, "OTHER").split()[0] if unicodedata.category(char).startswith("L") else None


def _scripts(spelt: list[str], words: SpeltWords, at: np.ndarray) -> list[str | None]:
    """The script that most letters of each text have (of equally many, the
    first by name); None without letters."""
    codes = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(spelt)), list(map(len, spelt)))
    known, where = np.unique(codes, return_inverse=True)
    named = [_script(c) for c in known.tolist()]
    n = len(words.counts)
    most, out = np.zeros(n), [None] * n
    for script in sorted(set(named) - {None}):
        letters = np.bincount(word, np.array([s == script for s in named])[where], len(spelt))
        each = np.bincount(words.owner(), letters[at], n)
        for k in np.flatnonzero(each > most).tolist():
            out[k] = script
        most = np.maximum(most, each)
    return out


def repeated_words(words: SpeltWords, size: int = WINDOW) -> np.ndarray:
    """For each text the words that lie in windows of ``size`` words found
    twice or more in it. Windows are met by a hash, then compared word by word."""
    n, owner = len(words.number), words.owner()
    at = np.arange(max(0, n - size + 1))
    at = at[owner[at] == owner[at + size - 1]] if len(at) else at
    name = owner[at].astype(np.uint64)
    for k in range(size):
        name = (name ^ words.number[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    ordered = np.sort(name)
    several = ordered[1:][ordered[1:] == ordered[:-1]]
    at = at[several[np.minimum(np.searchsorted(several, name), len(several) - 1)] == name] if len(several) else at[:0]
    columns = [owner[at], *[words.number[at + k] for k in range(size)]]
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(at) - 1), bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(n + size + 1, np.int64)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + size, -1)
    return np.bincount(owner, np.cumsum(depth)[:n] > 0, len(words.counts)).astype(np.int64)


def _repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += bool(line.split(None, 1))
        else:
            seen.add(line)
    return again


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return np.diff(sums[offsets])


def _measured(vocabulary: Vocabulary, spelt: list[str], words: SpeltWords, at: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
    ids, first = vocabulary.tokens(spelt)
    n, owner, many = len(words.counts), words.owner(), np.diff(first)
    lone = np.concatenate([[0], np.cumsum(vocabulary.lone[ids])])
    size = many[at]
    tokens = np.bincount(owner, size, n)
    bytes_ = np.bincount(owner, (lone[first[1:]] - lone[first[:-1]])[at], n)
    place = np.arange(size.sum()) + np.repeat(first[at] - np.cumsum(size) + size, size)
    key = np.sort(np.repeat(owner * len(vocabulary.lone), size) + ids[place])
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(starts, append=len(key))
    # in fixed point, so that the order of adding changes nothing
    weight = np.rint(count * np.log2(count) * _FINE)
    some = np.maximum(tokens, 1)
    entropy = np.log2(some) - np.bincount(key[starts] // len(vocabulary.lone), weight, n) / _FINE / some
    return {"tokens": tokens.astype(np.int64), "chars_per_token": chars / some, "byte_share": bytes_ / some, "entropy": np.maximum(entropy, 0)}


def _measurer(files, names: tuple[str, ...]):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("script", pa.string()),
                        *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        *[(f"{m}_{k}", pa.int64() if m == "tokens" else pa.float64()) for k in range(len(names)) for m in ("tokens", *MEASURES)]])

    def measure(batches):
        vocabularies = _worker(files)
        for rows, data, offsets in chunks(batches, size=_BYTES):
            words = SpeltWords(data, offsets)
            at = words.number - 1
            spelt = words.dictionary()
            chars = _per_text(words.inside & ((data & 0xC0) != 0x80), offsets)
            raw, cuts = data.tobytes(), offsets.tolist()
            out = {"doc_id": rows.column(0), "lang": rows.column(2), "script": _scripts(spelt, words, at), "n_words": words.counts, "word_chars": chars,
                   "n_symbols": _per_text(_SYMBOLS[data], offsets), "n_dup_lines": [_repeated_lines(raw[a:b]) for a, b in zip(cuts, cuts[1:])],
                   "n_repeat_words": repeated_words(words)}
            for k, vocabulary in enumerate(vocabularies):
                out |= {f"{m}_{k}": x for m, x in _measured(vocabulary, spelt, words, at, chars).items()}
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in schema], schema=schema)
    return measure, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'string'}" for f in schema)


def fertility(docs: DataFrame, folder: str = FOLDER, names: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """Base counts and measures of every row of ``docs`` (doc_id, text, lang):
    tokens_k, chars_per_token_k, byte_share_k, entropy_k (bits a token) with
    the k-th vocabulary. A word is ``[^\\x20\\x09-\\x0D]+`` and encoded after one
    blank. A null or empty text has no words and zeros; a text is measured
    whole, in memory of some 300 bytes for each of its words."""
    spark = docs.sparkSession
    run, schema = _measurer(spark.sparkContext.broadcast(contents(folder, names)), names)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.col("lang").cast("string").alias("lang"))
    return whole.mapInArrow(run, schema)


def _octave() -> Column:
    """Length class of a text: octaves of words, which no vocabulary changes."""
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))).cast("long")


def bands(measured: DataFrame, n: int, width: float = WIDTH) -> DataFrame:
    """The bands that all documents give: (by, group, octave, measure, k, low,
    high), bounds in steps of the measure; ``by`` is lang or script. Measures
    are counted in steps, so quartiles come from exact counts."""
    rows = []
    for k in range(n):
        for m, (step, *_) in MEASURES.items():
            rows.append(F.named_struct(F.lit("measure"), F.lit(m), F.lit("k"), F.lit(k), F.lit("octave"), _octave(),
                                       F.lit("steps"), F.floor(F.col(f"{m}_{k}") / step + 0.5).cast("long")))
    groups = F.array(F.struct(F.lit("lang").alias("by"), F.col("lang").alias("group")), F.struct(F.lit("script").alias("by"), F.col("script").alias("group")))
    said = (measured.where(F.col("n_words") >= LEAST_WORDS).select(F.explode(groups).alias("g"), F.array(*rows).alias("rows"))
            .where("g.group is not null").select("g.*", F.explode("rows").alias("r")).select("by", "group", "r.*"))
    counts = said.groupBy("by", "group", "measure", "k", "octave", "steps").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("by", "group", "measure", "k", "octave")
    below = F.sum("n").over(own.orderBy("steps").rowsBetween(Window.unboundedPreceding, 0))
    spread = counts.withColumn("below", below).withColumn("all", F.sum("n").over(own))
    at = lambda share: F.min(F.when(F.col("below") >= share * F.col("all"), F.col("steps")))
    quart = (spread.groupBy("by", "group", "measure", "k", "octave").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("n"))
             .where(F.col("n") >= LEAST_GROUP))
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, said in MEASURES.items() for x in (m, said[i])]), F.col("measure"))
    wide = F.greatest((F.lit(width) * (F.col("q3") - F.col("q1"))).cast("long"), of(1).cast("long"))
    return quart.select("by", "group", "octave", "measure", "k",
                        F.when(of(2) > 0, F.col("q1") - of(2) * wide).alias("low"), (F.col("q3") + of(3) * wide).alias("high"))


def _bounds(made: DataFrame, by: str) -> DataFrame:
    """One row for each group: its bounds by measure, vocabulary and octave."""
    at = F.concat_ws(":", "measure", "k", "octave")
    return (made.where(F.col("by") == by).groupBy(F.col("group").alias(f"b_{by}"))
            .agg(F.map_from_entries(F.collect_list(F.struct(at, F.struct("low", "high")))).alias(f"of_{by}")))


def quality(docs: DataFrame, folder: str = FOLDER, names: tuple[str, ...] = VOCABULARIES, width: float = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the columns of
    ``fertility``, base_failed, outside (measures beyond their band, each as
    measure:vocabulary:low or high) and kept.

    base_failed: fewer than BASE_WORDS words, or more than BASE_REPEATS percent
    of them in repeated windows. kept: neither base_failed nor outside any
    band. Bands are those of ``bands`` over all rows of ``docs``; a group too
    small for one rejects nothing by itself. A null lang is judged by its
    script, a text without letters by none; null, empty and blank texts fail the
    base. Rows are judged one by one: repeated or null doc_ids change nothing.
    Other columns are ignored; an empty table gives no rows.
    """
    measured = stored(fertility(docs, folder, names))
    made = stored(bands(measured, len(names), width))
    rows = measured
    for by in ("lang", "script"):
        own = stored(_bounds(made, by))
        rows = rows.join(own, F.col(by) == F.col(f"b_{by}"), "left").drop(f"b_{by}")
    outside = []
    for k in range(len(names)):
        for m, (step, *_) in MEASURES.items():
            at = F.concat_ws(":", F.lit(m), F.lit(k), _octave())
            band = F.coalesce(F.try_element_at("of_lang", at), F.try_element_at("of_script", at))
            steps = F.floor(F.col(f"{m}_{k}") / step + 0.5).cast("long")
            outside.append(F.when(steps < band["low"], f"{m}:{k}:low").when(steps > band["high"], f"{m}:{k}:high"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    listed = F.when(F.col("n_words") >= LEAST_WORDS, F.filter(F.array(*outside), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    out = rows.select(*measured.columns, failed.alias("base_failed"), listed.alias("outside"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
