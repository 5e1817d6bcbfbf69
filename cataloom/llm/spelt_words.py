"""Words of whole texts by number, equal exactly where their bytes are equal.

A word is ``[^\\x20\\x09-\\x0D]+``. All texts of a chunk are handled as one byte
array, and no word becomes an object of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class SpeltWords:
    """Words of consecutive texts: ``number`` (from 1 on, in order of first
    appearance in the chunk), byte ``start`` and ``end`` in ``data``, and
    ``first``: index of each text's first word, with the total at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.inside = ~_SPACE[data]
        opens, closes = self.inside.copy(), np.zeros(len(data) + 1, bool)
        opens[1:] &= ~self.inside[:-1]
        closes[1:-1] = self.inside[:-1] & ~self.inside[1:]
        closes[-1] = bool(len(data)) and self.inside[-1]
        border = offsets[(offsets > 0) & (offsets < len(data))]
        cut = border[self.inside[border] & self.inside[border - 1]]  # a text ends in a word and the next starts with one
        opens[cut] = closes[cut] = True
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, offsets, "left")
        self.first[-1] = len(self.start)
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        values = pa.py_buffer(np.ascontiguousarray(data[self.inside]))
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), values])
        coded = words.dictionary_encode()
        self.spelt, self.distinct = coded.dictionary, len(coded.dictionary)
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def dictionary(self) -> list[str]:
        """The distinct words, by number from 1 on."""
        if not self.distinct:
            return []
        ends = np.frombuffer(self.spelt.buffers()[1], np.int64)[self.spelt.offset:][:self.distinct + 1]
        letters = np.frombuffer(self.spelt.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        return np.insert(letters, ends[1:-1] - ends[0], 32).tobytes().decode("utf-8", "replace").split(" ")

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def apart(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers with one more after each text that is found once only,
        index of each text's first word among them)."""
        n = len(self.first) - 1
        first = self.first[:-1] + np.arange(n)
        out = np.empty(len(self.number) + n, np.int64)
        ends = first + self.counts
        plain = np.ones(len(out), bool)
        plain[ends] = False
        out[plain] = self.number
        out[ends] = self.distinct + 1 + np.arange(n)
        return out, first

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """The kept words of each text, joined by one space."""
        owner, length = self.owner(), self.end - self.start
        last = np.zeros(len(kept), bool)
        at = np.flatnonzero(kept)
        last[at[np.flatnonzero(np.diff(owner[at], append=-1))]] = True
        mask = self.inside.copy()
        mask[self.inside] = np.repeat(kept, length)
        spaced = self.end[kept & ~last]  # there is white space before the next word
        body = self.data.copy()
        body[spaced] = 32
        mask[spaced] = True
        size = np.bincount(owner, np.where(kept, length + ~last, 0), len(self.first) - 1).astype(np.int64)
        cuts, raw = np.concatenate([[0], np.cumsum(size)]).tolist(), body[mask].tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]
