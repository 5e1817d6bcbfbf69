"""Repeated passages by recompression of word sequences.

Every text is a sequence of word symbols. Rounds name its runs and then its
pairs of neighbours (a symbol of the left class followed by one of the right
class) by a hash of what they stand for, so all tasks give equal substrings
equal names without a shared dictionary, except near the ends of the
substring. Each symbol carries the words that its name depends on. A window
of WINDOW words is represented by one of the high-level symbols that depend
on nothing outside it (of those of most words, the one with the least name): equal windows have equal representatives.

Round one over the cluster finds the representatives that several parts or
documents share. Only windows under a shared one are named themselves; round
two finds, for each, whether an earlier document has it, and the words that
such windows cover go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.exchange import answer_bits, ask
from cataloom.llm.tables import stored, texts
from cataloom.llm.words import Words, chunks, mix, windows

U = np.uint64
WINDOW = 13
SYMBOL_BITS = 48
_PAIR_ROUNDS = 2
_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def recompress(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, words, from, to): high-level symbols of consecutive texts,
    how many words each stands for, and the words from (included) to
    (excluded) that its name depends on. A name that depends on a text's
    border reaches past it."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    length = np.diff(start, append=n)
    symbol, words, low, high, doc = mix(name[start] + length.astype(U) * _K1), length, start - 1, start + length + 1, doc[start]
    for r in range(_PAIR_ROUNDS):
        salt = mix(np.array([r + 1], U))[0]
        right = mix(symbol ^ salt) >> U(63) == 1
        same = np.zeros(len(symbol) + 1, bool)
        same[1:-1] = doc[1:] == doc[:-1]  # between i - 1 and i
        pair = ~right[:-1] & right[1:] & same[1:-1]
        # alone: a left symbol has seen its right neighbour, a right one its left neighbour
        to = np.where(~right & same[1:], np.append(high[1:], 0), high)
        since = np.where(right & same[:-1], np.insert(low[:-1], 0, 0), low)
        joined = np.append(pair, False)
        named = symbol.copy()
        named[joined] = mix(symbol[:-1][pair] * _K1 + symbol[1:][pair] * _K2 + salt)
        since[joined], to[joined] = low[joined], high[1:][pair]
        spanned = words.copy()
        spanned[joined] += words[1:][pair]
        keep = np.insert(~pair, 0, True)
        symbol, words, low, high, doc = named[keep], spanned[keep], since[keep], to[keep], doc[keep]
    return symbol, words, low, high


def _starts(w: Words, size: int) -> np.ndarray:
    """First words of all windows within a text."""
    at = np.arange(len(w.name))
    return at[at + size <= np.repeat(w.first[1:], w.counts)]


def representatives(w: Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(starts, keys): of each window its first word and its representative.
    A window without a symbol of its own is represented by its words."""
    starts = _starts(w, size)
    if not len(starts):
        return starts, np.zeros(0, U)
    symbol, words, low, high = recompress(w.name, w.owner())
    # symbols of many words come first: those of one or two are everywhere
    least = [(U(15) - np.minimum(words, 15).astype(U) << U(60)) | (symbol >> U(4))]
    while 2 << (len(least) - 1) <= size:
        step, last = 1 << (len(least) - 1), least[-1]
        least.append(np.minimum(last, np.append(last[step:], last[-1:].repeat(min(step, len(last))))[:len(last)]))
    a, b = np.searchsorted(low, starts, "left"), np.searchsorted(high, starts + size, "right")
    own = b <= a
    level = np.zeros(len(starts), np.int64)
    level[~own] = np.log2((b - a)[~own]).astype(np.int64)
    keys = np.empty(len(starts), U)
    for k in range(len(least)):
        here = ~own & (level == k)
        keys[here] = np.minimum(least[k][a[here]], least[k][b[here] - (1 << k)])
    keys[own] = windows(w.name, size)[starts[own]] ^ _K2
    return starts, mix(keys) >> U(64 - SYMBOL_BITS)


def _stretches(w: Words, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a stretch of windows of one text with one representative begins."""
    owner = w.owner()[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return np.flatnonzero(new)


_REVEALED = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("index", pa.binary()), ("stretches", pa.list_(pa.int64())),
                       ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("shas", pa.list_(pa.string()))])


def _reveal(batches):
    """One row for each part: the representatives of its windows."""
    seq = TaskContext.get().partitionId() << 32
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets)
        starts, keys = representatives(w)
        at = _stretches(w, starts, keys)
        distinct, index = np.unique(keys[at], return_inverse=True)
        doc = w.owner()[starts[at]] if len(at) else at
        whole = data.tobytes()
        yield pa.RecordBatch.from_pydict({
            "part": [seq], "keys": [distinct.tobytes()], "index": [index.astype(np.uint32).tobytes()],
            "stretches": [np.bincount(doc, minlength=rows.num_rows)], "ids": [rows.column(0).to_pylist()], "tags": [rows.column(2).to_pylist()],
            "words": [w.counts], "shas": [[hashlib.sha256(b" ".join(whole[a:b].split())).hexdigest() for a, b in zip(offsets, offsets[1:])]]}, _REVEALED)
        seq += 1


def _told(batches):
    """Back to documents: which stretches have a shared representative."""
    for batch in batches:
        out = {k: [] for k in ("doc_id", "tag", "n_words", "kept_sha256", "flags")}
        for row in batch.to_pylist():
            index = np.frombuffer(row["index"], np.uint32)
            stretches = np.array(row["stretches"], np.int64)
            doc = np.repeat(np.arange(len(stretches)), stretches)
            if row["answers"]:
                # twice within the part: by two documents, or by one (then nothing earlier is found)
                shared = answer_bits(row["answers"]) | (np.bincount(index) > 1)
            else:
                shared = np.zeros(0, bool)
            flags = shared[index] if len(index) else np.zeros(0, bool)
            ends = np.cumsum(stretches)
            some = np.bincount(doc, flags, len(stretches)) > 0
            for i, (a, b) in enumerate(zip(ends - stretches, ends)):
                for k, v in zip(out, (row["ids"][i], row["tags"][i], row["words"][i], row["shas"][i],
                                      np.packbits(flags[a:b]).tobytes() if some[i] and row["ids"][i] is not None else None)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()),
                                                         ("kept_sha256", pa.string()), ("flags", pa.binary())]))


_SUSPECT = pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.binary())),
                     ("ends", pa.list_(pa.int64())), ("texts", pa.binary())])


def _gather(batches):
    """Documents with shared representatives, in parts. A part's texts are
    compressed together: they are written and shuffled once more each."""
    seq = TaskContext.get().partitionId() << 32
    for rows, data, offsets in chunks(batches):
        yield pa.RecordBatch.from_pydict({"part": [seq], "ids": [rows.column(0)], "flags": [rows.column(1)], "ends": [offsets],
                                          "texts": [pa.compress(data.tobytes(), codec="zstd", asbytes=True)]}, _SUSPECT)
        seq += 1


def _open_windows(row: dict) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts, owners, names) of a part's windows under shared
    representatives."""
    offsets = np.array(row["ends"], np.int64)
    w = Words(np.frombuffer(pa.decompress(row["texts"], int(offsets[-1]), codec="zstd"), np.uint8), offsets)
    starts, keys = representatives(w)
    at = _stretches(w, starts, keys)
    owner = w.owner()[starts]
    flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8))[:n] for f, n in
                            zip(row["flags"], np.bincount(owner[at], minlength=len(row["ids"])))]).astype(bool)
    shared = np.repeat(flags, np.diff(at, append=len(starts)))
    return w, starts[shared], owner[shared], windows(w.name, WINDOW)[starts[shared]]


def _firsts(row: dict) -> tuple:
    """(words, starts, owners, index, distinct names, firsts): the smallest
    document of the part that has each name."""
    w, starts, owner, names = _open_windows(row)
    distinct, index = np.unique(names, return_inverse=True)
    firsts = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(firsts, index, np.array(row["ids"], np.int64)[owner])
    return w, starts, owner, index, distinct, firsts


def _name(batches):
    for batch in batches:
        for row in batch.to_pylist():
            *_, distinct, firsts = _firsts(row)
            yield pa.RecordBatch.from_pydict({"part": [row["part"]], "keys": [distinct.tobytes()], "firsts": [firsts.tobytes()]},
                                             pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("firsts", pa.binary())]))


def _cut(with_text: bool):
    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w, starts, owner, index, _, firsts = _firsts(row)
                ids = np.array(row["ids"], np.int64)
                covered = starts[answer_bits(row["answers"])[index] | (firsts[index] < ids[owner])]
                depth = np.zeros(len(w.name) + 1, np.int64)
                np.add.at(depth, covered, 1)
                np.add.at(depth, covered + WINDOW, -1)
                stays = np.cumsum(depth)[:-1] == 0
                whole = w.data.tobytes()
                out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
                for doc, a, b in zip(row["ids"], w.first, w.first[1:]):
                    kept = a + np.flatnonzero(stays[a:b])
                    text = b" ".join([whole[x:y] for x, y in zip(w.start[kept].tolist(), w.end[kept].tolist())])
                    for k, v in zip(out, (doc, int(b - a), int(b - a) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None)):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                                                                 ("kept_sha256", pa.string()), ("kept_text", pa.string())]))
    return cut


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words,
    n_removed, kept_sha256, and kept_text if ``with_text``: the kept words
    joined by one space (null where nothing was removed: the text's own words).

    Words are ``[^\\x20\\x09-\\x0D]+``. Each word goes that is covered by a
    window of 13 consecutive words whose sequence also starts in a document
    with a smaller doc_id; windows are judged on the input. Windows are
    compared by names of 64 bits.

    A null text has no words. A null doc_id is neither smaller nor larger
    than another: its words stay, and remove none. Rows that repeat a doc_id
    don't remove each other's words. Other columns are ignored; an empty
    table gives no rows.
    """
    tagged = texts(docs).withColumn("tag", F.xxhash64("text"))
    parts = stored(tagged.mapInArrow(_reveal, "part long, keys binary, index binary, stretches array<long>, ids array<long>, "
                                              "tags array<long>, words array<long>, shas array<string>"))
    total = parts.agg(F.sum(F.length("keys"))).first()[0] or 0
    answers = ask(parts.select("part", "keys").where("length(keys) > 0"), SYMBOL_BITS, total // 8)
    told = stored(parts.drop("keys").join(answers, "part", "left").drop("part")
                  .mapInArrow(_told, "doc_id long, tag long, n_words long, kept_sha256 string, flags binary"))
    clean = told.where("flags is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    shared = stored(told.where("flags is not null").select("doc_id", "tag", "flags").dropDuplicates(["doc_id", "tag"]))
    suspects = stored(tagged.join(shared, ["doc_id", "tag"]).select("doc_id", "flags", "text")
                      .mapInArrow(_gather, "part long, ids array<long>, flags array<binary>, ends array<long>, texts binary"))
    named = suspects.mapInArrow(_name, "part long, keys binary, firsts binary")
    answers = ask(named, 64, total // 8, earlier=True)
    cut = (suspects.join(answers, "part")
           .mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))
    out = clean.unionByName(cut)
    return out if with_text else out.drop("kept_text")
