"""Periodic runs of words, found by longest common extensions.

The extensions come from a difference cover: only suffixes that start at
places of the cover are sorted. Two places are compared word by word until
both are in the cover; the rest is a range minimum, from a sparse table, over
the common prefixes of neighbouring sorted suffixes. Periods are enumerated
on a harmonic grid: a run of at least four periods holds a multiple of three
periods together with the place one period on, so each period p of a text of n
words needs n / 3p pairs of places, extended both ways.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cataloom.llm.spelt_words import SpeltWords
from cataloom.llm.tables import texts
from cataloom.llm.words import chunks

#: Periods and words that a run has at least.
REPEATS, LEAST = 4, 6
#: The cover: every difference modulo the first number is one of two members'.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
#: Pairs of places handled at a time.
_PAIRS = 1 << 20
_GRID = REPEATS - 1


def _cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """(index of a residue in the cover or -1; ahead[d, r]: how far from a place
    of residue r to the first one that is in the cover together with the place d on)."""
    place = np.full(MODULUS, -1)
    place[list(COVER)] = np.arange(len(COVER))
    ahead = np.zeros((MODULUS, MODULUS), np.int64)
    for d in range(MODULUS):
        for r in range(MODULUS):
            ahead[d, r] = next(k for k in range(MODULUS) if place[(r + k) % MODULUS] >= 0 and place[(r + d + k) % MODULUS] >= 0)
    return place, ahead


_PLACE, _AHEAD = _cover_tables()


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row of non-negative columns in lexicographic order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Extensions:
    """Longest common extensions to the right in ``words`` (numbers from 1 on):
    texts one after another, each with a number at its end that is found once,
    and ``text`` the text of each place. Only texts in which some pair of places
    agrees as far as the next members of the cover are sorted."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n, self.text = len(words), text
        self.words = np.concatenate([words, np.zeros(2 * MODULUS, np.int64)])
        self.sorted = np.zeros(int(text[-1]) + 1 if len(text) else 0, bool)
        self.least: list[np.ndarray] = []

    def _sort(self, more: np.ndarray) -> None:
        """Ranks of the sampled suffixes of texts by prefixes of MODULUS * 2^k
        words, until all differ; then the common prefixes of neighbours."""
        self.sorted[more] = True
        at = (np.arange(0, self.n, MODULUS)[:, None] + np.array(COVER)[None, :]).ravel()
        here = np.flatnonzero(at < self.n)
        here = here[self.sorted[self.text[at[here]]]]
        self.index = np.full(len(at), -1)
        self.index[here] = np.arange(len(here))
        at = at[here]
        width = max(1, int(self.words.max(initial=0)).bit_length())
        together = 63 // width
        columns = []
        for lo in range(0, MODULUS, together):
            key = np.zeros(len(at), np.int64)
            for k in range(lo, min(MODULUS, lo + together)):
                key = (key << width) | self.words[at + k]
            columns.append(key)
        ranks = [_dense(columns)]
        step = len(COVER)
        while ranks[-1].max() < len(at) - 1:
            then = np.zeros(len(at), np.int64)
            then[:-step] = ranks[-1][step:] + 1
            ranks.append(_dense([ranks[-1], then]))
            step *= 2
        self.rank = ranks.pop()
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            jump, last = len(COVER) << k, len(at) - 1
            same = (np.maximum(a, b) <= last) & (ranks[k][np.minimum(a, last)] == ranks[k][np.minimum(b, last)])
            common[same] += MODULUS << k
            a[same] += jump
            b[same] += jump
        first, second, open_ = at[order[:-1]] + common, at[order[1:]] + common, np.arange(len(common))
        for _ in range(MODULUS):
            open_ = open_[self.words[first[open_]] == self.words[second[open_]]]
            for x in (first, second, common):
                x[open_] += 1
        self.least = [common]
        while 2 << len(self.least) - 1 <= len(common):
            below, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(below[:-half], below[half:]))

    def _ranked(self, at: np.ndarray) -> np.ndarray:
        return self.rank[self.index[at // MODULUS * len(COVER) + _PLACE[at % MODULUS]]]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the places i and j > i of one text agree."""
        ahead = _AHEAD[(j - i) % MODULUS, i % MODULUS]
        out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(MODULUS + 1):  # one word more: most pairs end here
            open_ = open_[self.words[i[open_] + k] == self.words[j[open_] + k]]
            out[open_] = k + 1
            open_ = open_[ahead[open_] > k]
        far = np.flatnonzero(out > ahead)
        if len(far):
            i, j = i[far] + ahead[far], j[far] + ahead[far]
            asked = np.unique(self.text[i])
            if not self.sorted[asked].all():
                self._sort(asked)
            a, b = self._ranked(i), self._ranked(j)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            depth = np.frexp((hi - lo).astype(np.float64))[1] - 1
            found = np.empty(len(far), np.int64)
            for d in np.unique(depth).tolist():
                own = depth == d
                table = self.least[d]
                found[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << d)])
            out[far] = ahead[far] + found
        return out


def _pairs(first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): for texts of ``counts`` words from ``first`` on, the
    multiples of _GRID periods that have a word one period on."""
    periods = counts // REPEATS
    text = np.repeat(np.arange(len(first)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    many = -(-(counts[text] - period) // (_GRID * period))
    before = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + _PAIRS, "right")) - 1)
        own = np.repeat(np.arange(lo, hi), many[lo:hi])
        k = np.arange(len(own)) + before[lo] - before[own]
        p = period[own]
        yield first[text[own]] + k * _GRID * p, p
        lo = hi


def runs(words: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(start, period, length) of all runs, by start, then period: of the texts
    that lie in ``words`` (numbers from 1 on; another one, found once, after each text)."""
    text = np.repeat(np.arange(len(first)), counts + 1)
    # mirrored, each text has its own end before it and the next one's after it
    ahead, back = Extensions(words, text), Extensions(words[::-1].copy(), text[-1:] - text[::-1])
    n, found = len(words), []
    for at, p in _pairs(first, counts):
        same = words[at] == words[at + p]
        at, p = at[same], p[same]
        right = ahead(at, at + p)
        # of two mirrored places, the later one comes first
        left = back(n - at - p, n - at)
        long = left + right + p >= np.maximum(LEAST, REPEATS * p)
        found.append(np.unique(np.stack([(at - left)[long], (left + right + p)[long], p[long]], 1), axis=0))
    all_ = np.unique(np.concatenate(found or [np.zeros((0, 3), np.int64)]), axis=0)
    # a stretch found under several periods has the smallest of them
    smallest = np.ones(len(all_), bool)
    smallest[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)
    out = all_[smallest][:, [0, 2, 1]]
    return out[np.lexsort((out[:, 1], out[:, 0]))]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _finder(with_text: bool):
    def find(batches):
        for rows, data, offsets in chunks(batches):
            words = SpeltWords(data, offsets)
            joined, first = words.apart()
            found = runs(joined, first, words.counts)
            own = np.searchsorted(first, found[:, 0], "right") - 1
            found[:, 0] -= own  # the numbers at the ends of texts before it
            cuts = np.searchsorted(own, np.arange(len(first) + 1))
            depth = np.zeros(len(words.number) + 1, np.int64)
            np.add.at(depth, found[:, 0] + found[:, 1], 1)
            np.add.at(depth, found[:, 0] + found[:, 2], -1)
            kept = words.joined(np.cumsum(depth)[:-1] == 0)
            found[:, 0] -= words.first[own]
            spans = [{"start": s, "length": n, "period": p} for s, p, n in found.tolist()]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(words.counts, pa.int64()), pa.array([spans[a:b] for a, b in zip(cuts, cuts[1:])], _RUN),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.array([x.decode() for x in kept] if with_text else [None] * len(kept), pa.string())], schema=_SCHEMA)
    return find


def periodic_runs(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (array
    of start, length, period by start, then period), kept_sha256, and kept_text
    if ``with_text``: the words, joined by one space, that no run holds after
    its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` and compared as they are. A run is a
    stretch with smallest period p (words p apart are equal) of at least
    max(LEAST, REPEATS * p) words that no neighbouring word extends. Runs may
    overlap. A null, empty or blank text has no words and no runs. Rows are
    judged one by one, so repeated or null doc_ids change nothing; a text is
    taken whole, in memory of about 200 bytes for each of its words. Other
    columns are ignored; an empty table gives no rows.
    """
    run = "array<struct<start: long, length: long, period: long>>"
    out = texts(docs).mapInArrow(_finder(with_text), f"doc_id long, n_words long, runs {run}, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
