"""Which keys does another part of the data hold too? Asked by sending
compressed keys and answered by bitmaps.

A part is a bounded piece of the data: one row with its sorted, distinct
64-bit keys. Each part sends every owner (an owner has a range of the keys)
its keys as Golomb-coded gaps; the owner merges the lists of all parts and
sends back one bit for each key. A key that a third of all rows hold reaches
its owner once from each part, as a few bits.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import few, partitions

U = np.uint64
#: Keys that one owner merges at a time, on average.
OWNER_KEYS = 1 << 20


def golomb(gaps: np.ndarray, span: float) -> tuple[int, bytes, bytes]:
    """Golomb code with a power of two as parameter: the quotients in unary
    and the remainders in binary, each as a bit stream of its own."""
    n = len(gaps)
    r = min(63, max(0, int(math.log2(max(1.0, span / max(n, 1))))))
    ends = np.cumsum((gaps >> U(r)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - r:] if r else np.zeros(0, np.uint8)
    return r, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def ungolomb(n: int, r: int, unary: bytes, low: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = np.diff(ones, prepend=-1).astype(U) - U(1)
    if r:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - r:] = np.unpackbits(np.frombuffer(low, np.uint8))[:n * r].reshape(n, r)
        gaps = (gaps << U(r)) | np.packbits(bits, axis=1).view(">u8").ravel().astype(U)
    return gaps


def _numbers(x: np.ndarray) -> bytes:
    """Numbers as deflated offsets from the least one, as wide as needed."""
    base = x.min()
    offset = (x - base).view(U)
    width = next(w for w in (1, 2, 4, 8) if int(offset.max()) < 1 << 8 * w)
    return base.tobytes() + bytes([width]) + zlib.compress(offset.astype(f"<u{width}").tobytes(), 1)


def _unnumbers(said: bytes) -> np.ndarray:
    return np.frombuffer(said[:8], np.int64) + np.frombuffer(zlib.decompress(said[9:]), f"<u{said[8]}").astype(U).view(np.int64)


def _owners(bits: int, owners: int) -> int:
    """Shift that leaves a key its owner; the number of owners is a power of two."""
    return bits - max(1, math.ceil(math.log2(max(2, owners))))


def _sender(bits: int, shift: int):
    def send(batches):
        for batch in batches:
            rows = {k: [] for k in ("owner", "part", "n", "r", "unary", "low", "firsts")}
            for part, keys, firsts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys = np.frombuffer(keys, U)
                firsts = np.frombuffer(firsts, np.int64) if firsts else None
                at = keys >> U(shift)
                cuts = np.flatnonzero(np.diff(at, prepend=at[:1] + U(1))) if len(keys) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                    r, unary, low = golomb(np.diff(keys[lo:hi], prepend=at[lo] << U(shift)), 2.0 ** shift)
                    said = b"" if firsts is None else _numbers(firsts[lo:hi])
                    for k, v in zip(rows, (int(at[lo]), part, int(hi - lo), r, unary, low, said)):
                        rows[k].append(v)
                if sum(map(len, rows["unary"])) + sum(map(len, rows["low"])) > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, _SENT)
                    rows = {k: [] for k in rows}
            yield pa.RecordBatch.from_pydict(rows, _SENT)
    return send


_SENT = pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("r", pa.int64()),
                   ("unary", pa.binary()), ("low", pa.binary()), ("firsts", pa.binary())])


def _judge(shift: int, earlier: bool):
    def judge(sent: pd.DataFrame) -> pd.DataFrame:
        sent = sent.sort_values("part")
        base = U(int(sent["owner"].iloc[0]) << shift)
        keys = np.concatenate([base + np.cumsum(ungolomb(n, r, u, low)) for n, r, u, low in
                               zip(sent["n"], sent["r"], sent["unary"], sent["low"])])
        _, where, times = np.unique(keys, return_inverse=True, return_counts=True)
        if earlier:
            firsts = np.concatenate([_unnumbers(x) for x in sent["firsts"]])
            least = np.full(len(times), np.iinfo(np.int64).max)
            np.minimum.at(least, where, firsts)
            yes = least[where] < firsts
        else:
            yes = times[where] > 1
        ends = np.cumsum(sent["n"].to_numpy())
        bits = [np.packbits(yes[e - n:e]).tobytes() for n, e in zip(sent["n"], ends)]
        return pd.DataFrame({"part": sent["part"], "owner": sent["owner"], "n": sent["n"], "bits": bits})
    return judge


def ask(parts: DataFrame, bits: int, total: int, earlier: bool = False) -> DataFrame:
    """For ``parts`` (part long, keys binary, and firsts binary if
    ``earlier``; every part with at least one key) the table (part,
    answers): an array of (owner, n, bits) in the order of the part's keys. A bit says that another part
    holds the key too or, with ``earlier``, that another part gives the key a
    smaller number in ``firsts``.

    ``total`` is the number of keys in all parts: owners are as many as it
    takes for each to merge about OWNER_KEYS keys."""
    shift = _owners(bits, max(partitions(parts.sparkSession), total // OWNER_KEYS))
    firsts = F.col("firsts") if earlier else F.lit(b"").alias("firsts")
    sent = parts.select("part", "keys", firsts).mapInArrow(
        _sender(bits, shift), "owner long, part long, n long, r long, unary binary, low binary, firsts binary")
    back = few(sent.groupBy("owner").applyInPandas(_judge(shift, earlier), "part long, owner long, n long, bits binary"))
    answers = back.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("owner", "n", "bits"))).alias("answers"))
    return answers


def answer_bits(answers: list[dict]) -> np.ndarray:
    """The bits of all owners in key order."""
    return np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8))[:a["n"]] for a in answers]).astype(bool)
