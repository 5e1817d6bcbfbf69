"""Words of whole texts as arrays: byte positions and 64-bit names.

A word is ``[^\\x20\\x09-\\x0D]+``. All texts of a chunk are handled as one
byte array; a word's name is a polynomial of its bytes modulo 2**64, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=U)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E6C63D0876A9A47)
_WORD_BASE = U(0xD1342543DE82EF95)

#: Bytes of text handled at a time: bounds the temporary arrays.
CHUNK_BYTES = 2 << 20
_BLOCK = 1 << 18


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(base), -1, 2**64))
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_BASE, _BLOCK + 1)
_WUP, _WDOWN = _powers(_WORD_BASE, _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the words data[start:end], in blocks of whole words."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > _BLOCK:  # one word longer than a block: fold it block by block
            h = U(0)
            for at in range(lo, hi, _BLOCK):
                piece = _BYTE[data[at:min(hi, at + _BLOCK)]]
                h = mix(np.array([h], U))[0] + (piece * _UP[:len(piece)]).sum(dtype=U)
            out[i] = h
        else:
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(_BYTE[data[lo:hi]] * _UP[:hi - lo], out=sums[1:])
            out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * _DOWN[start[i:j] - lo]
        i = j
    return mix(out + (end - start).astype(U))


class Words:
    """Words of consecutive texts: ``name``, byte ``start`` and ``end`` in
    ``data``, and ``first``: index of each text's first word, with the total
    at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        inside = np.empty(len(data) + 1, bool)
        np.logical_not(_SPACE[data], out=inside[:-1])
        inside[-1] = False
        opens, closes = inside.copy(), np.zeros(len(data) + 1, bool)
        opens[1:] &= ~inside[:-1]
        closes[1:] = inside[:-1] & ~inside[1:]
        at = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        cut = at[inside[at] & inside[at - 1]]  # a text ends in a word and the next starts with one
        opens[cut] = closes[cut] = True
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, offsets, "left")
        self.name = _names(data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def windows(name: np.ndarray, size: int) -> np.ndarray:
    """Names of all windows of ``size`` consecutive entries (text borders are
    the caller's matter)."""
    n = len(name) - size + 1
    out = np.empty(max(n, 0), U)
    for lo in range(0, n, _BLOCK - size):
        hi = min(n, lo + _BLOCK - size)
        sums = np.zeros(hi - lo + size, U)
        np.cumsum(name[lo:hi + size - 1] * _WUP[:hi - lo + size - 1], out=sums[1:])
        out[lo:hi] = (sums[size:] - sums[:hi - lo]) * _WDOWN[:hi - lo]
    return mix(out + U(size))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): rows whose texts have about ``size`` bytes
    together; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi
