"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for every vocabulary piece at every place.
Forward Viterbi scores of all its nodes are exact heuristics for a backward
A* search, which takes the N best paths out one after another.

No piece goes on after a blank mark that follows other characters, nor beyond
a character that only single-character pieces hold. There every path of the
lattice passes through one node, so a text is a chain of short lattices
(units), and its N best paths change the best path in at most N - 1 units:
those whose second best path costs least. The Viterbi scores of all new units
of a chunk are computed together, along the edges that a tree of the pieces
finds; A* runs in the units that matter.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import texts
from cataloom.llm.words import U, chunks

#: The public BPE model with byte fallback; another file can be named.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
BLANK = "▁"
_LOW = -(1 << 60)
#: Units longer than this take the scalar path; units are scored so many at a time.
_LONG, _BATCH = 32, 4096
#: Bits of a slot of the piece tree's table, and of a character with room for a mark that is none.
_SLOTS, _CHAR = 18, 21
_NO_CHAR = (1 << _CHAR) - 1
_SPREAD = U(0xA24BAED4963EE407)
#: Units whose result a worker remembers.
_REMEMBERED = 250_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, whether it is a byte) by id; control and unknown
    pieces, which no text yields, have no piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        hidden = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        out.append(("" if hidden else model.id_to_piece(i), model.get_score(i), model.is_byte(i)))
    return out


def _fixed(scores: list[float]) -> tuple[np.ndarray, int]:
    """(scores times a power of two, that power): the smallest that makes all
    of them integers, so that sums are exact. The largest stays below 2^36, which
    leaves room for 2^24 pieces; a model that this would cost more than 2^-24 of
    a score is refused."""
    score, scale = np.array(scores, np.float64), 1
    if not np.isfinite(score).all():
        raise ValueError("a piece has no finite score")
    while (score * scale % 1).any() and np.abs(score).max() * 2 * scale < 1 << 36:
        scale *= 2
    fixed = np.rint(score * scale)
    if (np.abs(fixed / scale - score) > 2.0**-24).any():
        raise ValueError("scores of the pieces lie too far apart to be added exactly")
    return fixed.astype(np.int64), scale


class _Places(dict):
    """Units by the order in which they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        return at


class Lattice:
    """Units of texts and their best paths. Scores are integers: those of the
    model times ``scale``. Blanks are read as blank marks; a
    blank mark in the text itself, and any character without a piece, is
    spelt in bytes, at a cost below every piece's."""

    def __init__(self, pieces: list[tuple[str, float, bool]]):
        self.id_of = {p.replace(BLANK, " "): i for i, (p, _, byte) in enumerate(pieces) if p and not byte}
        self.score, self.scale = _fixed([s for _, s, _ in pieces])
        self.cost = self.score.tolist()
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, byte) in enumerate(pieces) if byte}
        self.spelt = [bytes([int(p[1:-1], 16)]) if byte else p.replace(BLANK, " ").encode() for p, _, byte in pieces]
        self.unknown = int(min(self.score[i] for i in self.id_of.values())) - 10 * self.scale
        self.longest = max(map(len, self.id_of))
        if any(" " in p.lstrip(" ") for p in self.id_of):
            raise ValueError("a piece has a blank mark after other characters: texts can't be cut into units")
        joins = re.escape("".join(sorted({c for p in self.id_of if len(p) > 1 for c in p} - {" "})))
        self.cut = re.compile(f" *[{joins}]+| +|[^{joins} ]").findall
        self._index(list(self.id_of))
        self.known = _Places()
        self._forget()

    def _index(self, names: list[str]) -> None:
        """The tree of the pieces' characters. A node is known by its parent
        and character, and found in a table by some mixed bits of both; nodes
        that meet in a slot are chained."""
        lengths, codes = np.array(list(map(len, names))), self._codes("".join(names))
        at = np.cumsum(lengths) - lengths
        node, keys, count = np.zeros(len(names), np.int64), [np.array([-1])], 1
        for depth in range(self.longest):
            long = np.flatnonzero(lengths > depth)
            key, child = np.unique(node[long] << _CHAR | codes[at[long] + depth], return_inverse=True)
            node[long] = count + child
            keys.append(key)
            count += len(key)
        self.key = np.concatenate(keys)
        self.head, self.next = np.zeros(1 << _SLOTS, np.int64), np.zeros(count, np.int64)
        rest = np.arange(1, count)
        while len(rest):
            slot = self._slot(self.key[rest])
            _, first = np.unique(slot, return_index=True)
            self.next[rest[first]] = self.head[slot[first]]
            self.head[slot[first]] = rest[first]
            rest = np.delete(rest, first)
        self.own = np.full(count, -1)
        self.own[self._keys(names)] = list(map(self.id_of.__getitem__, names))

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(U) * _SPREAD >> U(64 - _SLOTS)).view(np.int64)

    def _step(self, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes by a character, 0 for none."""
        key = node << _CHAR | codes
        out = self.head[self._slot(key)]
        rest = np.flatnonzero(self.key[out] != key)
        while len(rest):
            more = self.next[out[rest]]
            out[rest] = more
            rest = rest[(more > 0) & (self.key[more] != key[rest])]
        return out

    def _keys(self, names: list[str]) -> np.ndarray:
        """The nodes of ``names``, 0 for what begins no piece."""
        lengths, codes = np.array(list(map(len, names))), self._codes("".join(names))
        at, node = np.cumsum(lengths) - lengths, np.zeros(len(names), np.int64)
        for depth in range(max(lengths)):
            long = np.flatnonzero((lengths > depth) & ((node > 0) | (depth == 0)))
            node[long] = self._step(node[long], codes[at[long] + depth])
        return node

    def _look_up(self, node: np.ndarray) -> np.ndarray:
        """Ids by node, -1 for none."""
        return self.own[node]

    def _forget(self) -> None:
        self.known.clear()
        self.flat = np.zeros(0, "<i4")
        self.size = self.first = self.best = self.delta = np.zeros(0, np.int64)
        self.several: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def edges(self, unit: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the edges that end at ``end``."""
        out = []
        for start in range(max(0, end - self.longest), end):
            i = self.id_of.get(unit[start:end], -1)
            if i >= 0:
                out.append((start, self.cost[i], (i,)))
            elif start == end - 1:
                out.append((start, self.unknown, tuple(self.byte_id[b] for b in unit[start].encode())))
        return out

    def forward(self, unit: str, into: Callable | None = None) -> list[int]:
        into = into or partial(self.edges, unit)
        best = [0] + [_LOW] * len(unit)
        for end in range(1, len(unit) + 1):
            best[end] = max(best[start] + score for start, score, _ in into(end))
        return best

    def nbest(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        """(score, ids as little-endian 32-bit numbers) of the ``n`` best
        paths, best first: A* from the end, with forward scores as exact
        heuristics, so paths come out in order of their scores.

        The ``n`` best paths need the ``n`` best ways from a place to the end
        only: no place is taken more often, and a way with ``n`` others before
        it is not kept. Equal costs leave the heap first-in first-out, so this
        changes no path and no order, and a run of one character, whose equal
        ways are without number, costs as much as any text of its length."""
        into = lru_cache(_LONG)(partial(self.edges, unit))
        best = self.forward(unit, into)
        heap, tick, out = [(-best[-1], 0, len(unit), 0, ())], itertools.count(1), []
        left = [n] * (len(unit) + 1)
        ways: dict[int, list[int]] = {}
        while heap and len(out) < n:
            cost, _, end, after, ids = heapq.heappop(heap)
            if not left[end]:
                continue
            left[end] -= 1
            if not end:
                flat: list[int] = []
                while ids:
                    own, ids = ids
                    flat += own
                out.append((-cost, np.array(flat, "<i4").tobytes()))
                continue
            for start, score, own in into(end):
                known = ways.setdefault(start, [])
                if len(known) < n:
                    heapq.heappush(known, score + after)
                elif score + after > known[0]:
                    heapq.heapreplace(known, score + after)
                else:
                    continue
                heapq.heappush(heap, (-(best[start] + score + after), next(tick), start, score + after, (own, ids)))
        return out

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Scores of the best paths, costs of the second best (-1 for none),
        and the best paths: the best path off the first one goes through an
        edge that the first one lacks. Of equal paths, the one whose last
        edge is longer."""
        lengths = np.array(list(map(len, units)))
        ends = np.cumsum(lengths + 1) - 1  # a unit has a place before each character and one at its end
        starts = ends - lengths
        codes = self._codes("\0".join(units) + "\0")
        codes[ends] = _NO_CHAR
        owner = np.repeat(np.arange(len(units)), lengths + 1)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        node, found = np.zeros(len(at), np.int64), []
        for depth in range(1, self.longest + 1):
            node = self._step(node, codes[at + (depth - 1)])
            own = self._look_up(node)
            if depth == 1:
                found.append((at, own, np.ones(len(at), np.int64)))  # what has no piece is spelt
            else:
                hit = np.flatnonzero(own >= 0)
                found.append((at[hit], own[hit], np.full(len(hit), depth)))
            alive = np.flatnonzero(node)
            at, node = at[alive], node[alive]
            if not len(at):
                break
        start, own, size = map(np.concatenate, zip(*found))
        end = start + size
        level = (end - starts[owner[end]]).astype(np.int16)
        order = np.argsort(level, kind="stable")
        start, own, size, end = start[order], own[order], size[order], end[order]
        gain = np.where(own >= 0, self.score[own], self.unknown)
        levels = np.cumsum(np.bincount(level, minlength=2)).tolist()
        # a place's score and the length of its edge in one number: of equal scores, the longer edge
        ahead, behind = np.full(len(codes), _LOW), np.full(len(codes), _LOW)
        ahead[starts] = behind[ends] = 0
        step = (gain << 6) + size
        for lo, hi in itertools.pairwise(levels):
            np.maximum.at(ahead, end[lo:hi], (ahead[start[lo:hi]] & -64) + step[lo:hi])
        for lo, hi in reversed(list(itertools.pairwise(levels))):
            np.maximum.at(behind, start[lo:hi], gain[lo:hi] + behind[end[lo:hi]])
        back, ahead = ahead & 63, ahead >> 6
        on = np.zeros(len(codes), bool)
        at = ends
        while len(at):
            on[at] = True
            at = at - back[at]
            at = at[back[at] > 0]
        taken = on[end] & (back[end] == size)
        path = np.full(len(codes), -2, "<i4")
        path[end[taken]] = own[taken]
        off = np.flatnonzero(~taken)
        second = np.full(len(units), _LOW)
        np.maximum.at(second, owner[end[off]], ahead[start[off]] + gain[off] + behind[end[off]])
        best = ahead[ends]
        used = path != -2
        raw, cuts = path[used].tobytes(), (4 * np.cumsum(used)[ends]).tolist()
        paths = [raw[x:y] for x, y in zip([0] + cuts, cuts)]
        for i in np.unique(owner[path == -1]).tolist():  # with characters spelt in bytes
            paths[i] = self.nbest(units[i], 1)[0][1]
        return best, np.where(second > _LOW // 2, best - second, -1), paths

    def learn(self, units: Collection[str]) -> np.ndarray:
        """Where the units are remembered; new ones are scored."""
        had, at = len(self.known), np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if had and len(self.known) > _REMEMBERED:
            self._forget()
            had, at = 0, np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        new = list(itertools.islice(self.known, had, None))
        if not new:
            return at
        size, flat, bests, deltas = [self.size], [self.flat], [self.best], [self.delta]
        for lo in range(0, len(new), _BATCH):
            own = new[lo:lo + _BATCH]
            best, delta, paths = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), [b""] * len(own)
            short = [i for i, unit in enumerate(own) if len(unit) <= _LONG]
            if short:
                best[short], delta[short], found = self._together([own[i] for i in short])
                for i, path in zip(short, found):
                    paths[i] = path
            for i, unit in enumerate(own):
                if len(unit) > _LONG:
                    found = self.nbest(unit, 2)
                    best[i], paths[i] = found[0]
                    delta[i] = best[i] - found[1][0] if len(found) > 1 else -1
            size.append(np.array(list(map(len, paths))) // 4)
            flat.append(np.frombuffer(b"".join(paths), "<i4"))
            bests.append(best)
            deltas.append(delta)
        self.size, self.flat = np.concatenate(size), np.concatenate(flat)
        self.best, self.delta = np.concatenate(bests), np.concatenate(deltas)
        self.first = np.cumsum(self.size) - self.size
        return at

    def units_of(self, text: str) -> list[str]:
        return self.cut(" " + text) if text else []

    def _found(self, units: list[str], at: np.ndarray, n: int) -> list[tuple[int, list[tuple[int, bytes]]]]:
        """N best: each a score and the units whose path differs, with that
        path."""
        best, delta = int(self.best[at].sum()), self.delta[at]
        open_ = np.flatnonzero(delta >= 0)
        if len(open_) > n - 1:
            cut = np.partition(delta[open_], n - 2)[n - 2] if n > 1 else -1
            below, equal = open_[delta[open_] < cut], open_[delta[open_] == cut]
            open_ = np.concatenate([below, equal[:n - 1 - len(below)]])
        found = [(0, [])]
        for i in sorted(open_.tolist()):
            unit = units[i]
            if (unit, n) not in self.several:
                found_here, path = self.nbest(unit, n), self._path(int(at[i]))
                # the path that stands as best need not be the first of equal ones
                self.several[unit, n] = [(found_here[0][0] - score, x) for score, x in found_here if x != path][:n - 1]
            found = sorted(found + [(cost + more, [*changes, (i, path)]) for cost, changes in found for more, path in self.several[unit, n]],
                           key=lambda x: (x[0], len(x[1]), x[1]))[:n]
        return [(best - cost, changes) for cost, changes in found]

    def _path(self, at: int) -> bytes:
        return self.flat[self.first[at]:self.first[at] + self.size[at]].tobytes()

    def encode(self, units: list[str], n: int = NBEST) -> tuple[list[bytes], list[tuple[int, list[tuple[int, bytes]]]]]:
        """(best paths of the units, N best as in ``_found``)."""
        at = self.learn(units)
        return list(map(self._path, at.tolist())), self._found(units, at, n)

    def segmentations(self, units_of: list[list[str]], n: int = NBEST) -> Iterator[list[tuple[int, bytes]]]:
        """For each text, given as its units: (score, ids) of the N best."""
        at = self.learn(list(itertools.chain.from_iterable(units_of)))
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - (ends - size), size) + np.arange(size.sum())]
        lo = done = 0
        for units in units_of:
            hi = lo + len(units)
            end = int(ends[hi - 1]) if units else done
            raw, whole = ids[done:end].tobytes(), []
            for score, changes in self._found(units, at[lo:hi], n):
                parts, kept = [], 0
                for i, path in changes:
                    upto = 4 * (int(ends[lo + i]) - done)
                    parts += [raw[kept:upto - 4 * int(size[lo + i])], path]
                    kept = upto
                whole.append((score, b"".join([*parts, raw[kept:]])))
            yield whole
            lo, done = hi, end

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: pieces with blank marks as blanks,
        bytes as UTF-8, without the leading blank. Unknown and control ids
        stand for nothing; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.spelt.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encoder(pieces, n: int, with_ids: int):
    import hashlib

    def encode(batches):
        lattice = Lattice(pieces.value)  # goes with its task: an idle Python worker keeps nothing of it
        for rows, _, _ in chunks(batches):
            out = {k: [] for k in _SCHEMA.names}
            said = rows.column(1).to_pylist()
            for doc, text, found in zip(rows.column(0).to_pylist(), said, lattice.segmentations(list(map(lattice.units_of, said)), n)):
                whole = [ids for _, ids in found]
                best = np.frombuffer(whole[0], "<i4")
                for k, v in zip(out, (doc, len(best), len(found), [s / lattice.scale for s, _ in found], hashlib.sha256(whole[0]).hexdigest(),
                                      hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in whole)).hexdigest(),
                                      lattice.decode(best) == text, [np.frombuffer(x, "<i4") for x in whole[:with_ids]])):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, _SCHEMA)
    return encode


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_found", pa.int64()), ("scores", pa.list_(pa.float64())),
                     ("ids_sha256", pa.string()), ("nbest_sha256", pa.string()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.list_(pa.int32())))])


def encode_nbest(docs: DataFrame, model: str = MODEL, n: int = NBEST, with_ids: int = NBEST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pieces (of the
    best segmentation), n_found (segmentations, ``n`` at most), scores
    (descending), ids_sha256 (best ids as little-endian 32-bit numbers),
    nbest_sha256, round_trip (decoding gives the text back), and ids (an
    array for each of the first ``with_ids`` segmentations) unless that is 0.

    The score of a segmentation is the sum of its pieces' scores in the
    model. A blank goes before the text. A null or empty text has one
    segmentation without pieces. Segmentations of equal scores come in an
    order that depends on the text alone. Null and repeated doc_ids are
    encoded row by row. Other columns are ignored; an empty table gives no
    rows.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model))  # as large as the vocabulary file
    out = texts(docs).mapInArrow(_encoder(pieces, n, with_ids), "doc_id long, n_pieces long, n_found long, scores array<double>, ids_sha256 string, "
                                 "nbest_sha256 string, round_trip boolean, ids array<array<int>>")
    return out if with_ids else out.drop("ids")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (doc_id, ids array<int>) as (doc_id, text); null ids give a
    null text."""
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary(model))

    def back(batches):
        lattice = Lattice(pieces.value)
        for batch in batches:
            said = [None if ids is None else lattice.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(back, "doc_id long, text string")
