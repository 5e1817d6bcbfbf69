"""Near duplicates: an inverted join over MinHash signature coordinates.

Documents are posted under each (coordinate, value) pair of their signature.
A pair of documents is a candidate when at least ``least_matches`` of the
COORDINATES collide, so it must share one of the first COORDINATES -
least_matches + 1 coordinates in any common order (prefix): postings are read rarest first and
only for the prefix. Coordinates that no other document shares come first in
that order and need no posting; the fingerprint exchange finds them. Lists
whose documents are in one candidate group already are skipped. Candidates
are confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.exchange import answer_bits, ask
from cataloom.llm.graph import Sets, components
from cataloom.llm.tables import dealt, stored, texts
from cataloom.llm.words import Words, chunks, mix, windows

U = np.uint64
SHINGLE = 5
COORDINATES, MATCHES = 64, 40
TOKEN_BITS = 48
#: Documents of one posting list or group compared in one go.
BLOCK = 256
#: Shingles of one side of such a comparison.
BLOCK_SHINGLES = 1 << 19
PART_DOCS = 1 << 13

def least_matches(threshold: int) -> int:
    """Collisions that a pair at the threshold (a percentage) falls short of
    by 5 deviations only, and MATCHES at most. At similarity 0.85 there are 54.4
    of 64 with deviation 2.9: fewer than 40 come up once in 410,000 pairs. At 0.80
    there are 51.2 with deviation 3.2: fewer than 35, once in 830,000 pairs."""
    p = threshold / 100
    return min(MATCHES, math.floor(COORDINATES * p - 5 * math.sqrt(COORDINATES * p * (1 - p))))


_RNG = np.random.default_rng(850)
_XOR = _RNG.integers(1, 2**64 - 1, COORDINATES, dtype=U)
_MUL = _RNG.integers(1, 2**64 - 1, COORDINATES, dtype=U) | U(1)
_SALT = mix(np.arange(1, COORDINATES + 1, dtype=U))


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(names, offsets): the distinct shingles of each text, sorted. A text
    of fewer than ``size`` words has its whole sequence as its one shingle."""
    first, counts = w.first, w.counts
    names = windows(w.name, size)
    sets = []
    for i, n in enumerate(counts):
        at = first[i]
        if n >= size:
            sets.append(np.unique(names[at:at + n - size + 1]))
        else:
            sets.append(windows(w.name[at:at + n], int(n)) if n else names[:0])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else names[:0]), offsets


def signatures(names: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COORDINATES minima for each set; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for c in range(COORDINATES):
            h = (names ^ _XOR[c]) * _MUL[c]
            out[full, c] = np.minimum.reduceat((h >> U(32)).astype(np.uint32), offsets[full])
    return out


def _sketch(batches):
    for rows, data, offsets in chunks(batches):
        names, at = shingle_sets(Words(data, offsets, lower=True))
        yield pa.RecordBatch.from_arrays([
            rows.column(0), rows.column(2), pa.array(np.diff(at)),
            *map(pa.array, _sums(names, at)),
            pa.array([s.tobytes() for s in signatures(names, at)], pa.binary())], ["doc_id", "tag", "n_shingles", "s1", "s2", "sig"])


def _tokens(sigs: np.ndarray) -> np.ndarray:
    return mix(sigs.astype(U) * U(0x9E3779B97F4A7C15) ^ _SALT) >> U(64 - TOKEN_BITS)


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, COORDINATES)


def _pack(batches):
    """A part's documents with the sorted distinct coordinate-value pairs."""
    seq = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, batch.num_rows, PART_DOCS):
            ids, sigs = (batch.column(i)[lo:lo + PART_DOCS].to_pylist() for i in range(2))
            keys = np.unique(_tokens(_signature_rows(sigs)))
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([keys.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64())),
                                              pa.array([b"".join(sigs)], pa.binary())], ["part", "keys", "ids", "sigs"])
            seq += 1


def _sharing(matches: int):
    """Documents with ``matches`` or more coordinates that another one shares."""
    def sharing(batches):
        for batch in batches:
            for keys, ids, sigs, answers in zip(*(batch.column(c).to_pylist() for c in ("keys", "ids", "sigs", "answers"))):
                sigs = np.frombuffer(sigs, np.uint32).reshape(-1, COORDINATES)
                tokens = _tokens(sigs)
                at = np.searchsorted(np.frombuffer(keys, U), tokens)
                shared = ((np.bincount(at.ravel()) > 1) | answer_bits(answers))[at]
                some = np.flatnonzero(shared.sum(1) >= matches)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(ids, np.int64)[some]), pa.array([sigs[i].tobytes() for i in some], pa.binary()),
                    pa.array([tokens[i][shared[i]].astype(np.int64) for i in some], pa.list_(pa.int64()))], ["rep", "sig", "tokens"])
    return sharing


def _colliding(matches: int):
    """Pairs whose signatures collide ``matches`` times."""
    def colliding(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_signature_rows(batch.column(c).to_pylist()) for c in ("sig", "pivot_sig"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= matches))
    return colliding


def _forest(n: int, pairs, ids: np.ndarray, start=None) -> list[tuple[int, int]]:
    """Of ``pairs``, those that join two groups; ``start`` are the groups so far."""
    sets, out = Sets(n), []
    if start is not None:
        _, first, where = np.unique(start, return_index=True, return_inverse=True)
        for i, g in enumerate(where):
            sets.join(i, int(first[g]))
    for i, j in pairs:
        if sets.join(int(i), int(j)):
            out.append((int(ids[i]), int(ids[j])))
    return out


def _links(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(found or np.zeros((0, 2), np.int64), columns=["a", "b"]).astype("int64")


def _collide(matches: int):
    """Links between candidate groups that a block of postings shows."""
    def collide(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in pdf.groupby("token"):
            if own["group"].nunique() < 2:
                continue
            own = own.drop_duplicates("rep")
            sigs, groups = _signature_rows(own["sig"]), own["group"].to_numpy()
            pairs = []
            for i in range(len(own) - 1):
                near = ((sigs[i + 1:] == sigs[i]).sum(1) >= matches) & (groups[i + 1:] != groups[i])
                pairs += [(i, j) for j in np.flatnonzero(near) + i + 1]
            found += _forest(len(own), pairs, own["rep"].to_numpy(), groups)
        return _links(found)
    return collide


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by incidence matrices over
    shingles that at least two of the sets have."""
    out = np.zeros((len(sets), len(sets)), np.float64)
    if not sets:
        return out
    names, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = times[where] > 1
    row, column = row[common], (np.cumsum(times > 1) - 1)[where[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, (1 << 22) // len(sets))
    for lo in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        has = np.zeros((len(sets), min(width, int(column[b - 1]) - lo + 1 if b > a else 1)), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        out += has @ has.T
    return out


def _verifier(threshold: int):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in pdf.groupby("candidate"):
            sets = [np.frombuffer(s, U) for s in own["shingles"]]
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets)
            near = (both > 0) & (100 * both >= threshold * (size[:, None] + size[None, :] - both))
            found += _forest(len(own), zip(*np.nonzero(np.triu(near, 1))), own["rep"].to_numpy())
        return _links(found)
    return verify


_SET_ROWS = "rep long, candidate long, members long, total long, shingles binary"


def _sums(names: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set that name it: equal sets have equal sums."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)]) for x in (mix(names + U(1)), mix(names ^ _XOR[0]))]
    return [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]


def _set_rows(batches):
    """The sets of the wanted classes, from the texts that stand for them
    (another text under the same doc_id has other sums)."""
    for rows, data, offsets in chunks(batches):
        names, at = shingle_sets(Words(data, offsets, lower=True))
        own = np.ones(rows.num_rows, bool)
        for got, said in zip([np.diff(at), *_sums(names, at)], rows.columns[4:7]):
            own &= got == said.to_numpy()
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array([names[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                                         ["rep", "candidate", "members", "total", "shingles"]).filter(pa.array(own))


def _units(rows: DataFrame, key: str, blocks, packed: int) -> DataFrame:
    """Deals each key's rows into blocks of bounded size and lays every two
    blocks of a key side by side (unit, i, j); keys of one block are packed
    together, about ``packed`` units in all."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", F.greatest(blocks.cast("long"), F.lit(1).cast("long"))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    return rows.select("*", other).select(
        *[c for c in rows.columns if c not in ("blocks", "own")],
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(key), F.lit(packed))).otherwise(F.xxhash64(key)).alias("unit"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("own", "other")).alias("i"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("own", "other")).alias("j"))


def near_dedup(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept, tag (a hash of the text).

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document's
    set holds its distinct five-word shingles, or its whole sequence if it is
    shorter. Documents are linked when 100 * intersection >= ``threshold`` *
    union (at least 80; ``least_matches`` follows from it). component_id is the
    smallest doc_id that links lead to.

    Null or empty texts have no shingles and no links. A null doc_id has a
    null component_id and kept false, and links nothing. Rows that repeat a
    doc_id are judged each by its own text.
    Equal sets are one class, so copies cost one signature. Other columns are
    ignored; an empty table gives no rows.
    """
    if not 80 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 80 to 100")
    matches = least_matches(threshold)
    plain = texts(docs).withColumn("tag", F.xxhash64("text"))
    sketch = stored(plain.mapInArrow(_sketch, "doc_id long, tag long, n_shingles long, s1 long, s2 long, sig binary"))
    ident = ["n_shingles", "s1", "s2"]
    classes = stored(sketch.where("n_shingles > 0 and doc_id is not null").groupBy(*ident).agg(F.min("doc_id").alias("stands"))
                     .withColumn("rep", F.xxhash64(*ident)), narrow=True)
    reps = stored(sketch.join(classes, ident).where("doc_id = stands").select("rep", "sig").dropDuplicates(["rep"]), narrow=True)
    total = reps.count()

    parts = stored(reps.select("rep", "sig").mapInArrow(_pack, "part long, keys binary, ids array<long>, sigs binary"))
    sharing = stored(parts.join(ask(parts, TOKEN_BITS, total * COORDINATES), "part").select("keys", "ids", "sigs", "answers")
                     .mapInArrow(_sharing(matches), "rep long, sig binary, tokens array<long>"), narrow=True)
    posted = sharing.select("rep", F.explode("tokens").alias("token"))
    times = stored(posted.groupBy(F.col("token").alias("posted")).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), narrow=True)
    ranked = posted.join(times, F.col("token") == F.col("posted")).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("ranked"))
    prefix = F.explode(F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - (matches - 1), F.lit(0)))).alias("entry")
    postings = stored(ranked.select("rep", prefix).select("rep", "entry.token", "entry.times"), narrow=True)

    pivots = stored(postings.groupBy(F.col("token").alias("pivot_token")).agg(F.min("rep").alias("pivot")), narrow=True)
    signed = sharing.select("rep", "sig")
    tried = (postings.join(pivots, F.col("token") == F.col("pivot_token")).where("rep <> pivot").select("rep", "pivot").distinct()
             .join(signed, "rep").join(signed.select(F.col("rep").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
             .select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "sig", "pivot_sig"))
    stars = stored(tried.mapInArrow(_colliding(matches), "a long, b long"), narrow=True)
    grouped = stored(postings.join(components(stars).withColumnRenamed("node", "rep"), "rep", "left")
                     .select("rep", "token", "times", F.coalesce("component", "rep").alias("group")), narrow=True)
    mixed = stored(grouped.where("times > 2").groupBy(F.col("token").alias("mixed"))
                   .agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("mixed"), narrow=True)
    open_lists = stored(grouped.join(mixed, F.col("token") == F.col("mixed")).join(signed, "rep").select("rep", "token", "times", "group", "sig"), narrow=True)
    blocks = F.ceil(F.col("times") / BLOCK)
    more = (_units(open_lists, "token", blocks, max(1, open_lists.count() // 2000)).select("unit", "i", "j", "token", "rep", "group", "sig")
            .groupBy("unit", "i", "j").applyInPandas(_collide(matches), "a long, b long"))
    candidates = stored(components(stored(stars.unionByName(more), narrow=True)).select(F.col("node").alias("rep"), F.col("component").alias("candidate")), narrow=True)

    members = stored(candidates.join(classes, "rep"), narrow=True)
    sizes = stored(members.groupBy("candidate").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total")), narrow=True)
    wanted = stored(members.join(sizes, "candidate").select("rep", "candidate", "members", "total", *ident, "stands"), narrow=True)
    sets = stored(plain.join(dealt(wanted), F.col("doc_id") == F.col("stands"))
                  .select("rep", "candidate", "members", "total", *ident, "text").mapInArrow(_set_rows, _SET_ROWS))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    packed = max(1, (wanted.count()) // 200)
    links = (_units(sets, "candidate", blocks, packed).select("unit", "i", "j", "candidate", "rep", "shingles")
             .groupBy("unit", "i", "j").applyInPandas(_verifier(threshold), "a long, b long"))
    reached = classes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = stored(reached.groupBy(F.col("component").alias("least_of")).agg(F.min("stands").alias("reached")), narrow=True)
    named = stored(reached.join(least, F.col("component") == F.col("least_of")).select(*[F.col(c).alias(f"class_{c}") for c in ident], "reached"), narrow=True)
    return (sketch.join(named, [F.col(c) == F.col(f"class_{c}") for c in ident], "left")
            .select("doc_id", "tag", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("reached")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "tag"))
