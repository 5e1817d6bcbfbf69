"""Small tables with awkward rows, and plain versions of the operators."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

#: Names that the operators use for columns of their own.
CLASHING = ("tag", "part", "keys", "rep", "token", "norm", "sha", "row", "words", "hashes", "item", "component", "votes", "k_id", "k_tag",
            "_tag", "_leak_id", "c_id", "flags", "at", "h1", "rule", "n_words", "kept", "archive", "offset")


def sentence(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(seed=1, docs=60):
    """(doc_id, text) rows: nulls, empty and blank texts, repeated rows, ties,
    a very long text, near copies, shared passages, runs of one word."""
    rng = random.Random(seed)
    passage, base = sentence(rng, 40), sentence(rng, 120)
    rows = [(i, sentence(rng, rng.randrange(1, 80))) for i in range(docs)]
    rows += [(100 + i, f"{sentence(rng, 10)} {passage}\n{sentence(rng, 5)}") for i in range(8)]
    for i in range(10):
        words = base.split()
        words[rng.randrange(120)] = f"edit{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, base), (301, base.upper()), (302, base + "  "), (303, base.replace(" ", "\t\n"))]
    rows += [(310, "a b c"), (311, "a  b c"), (312, "A b c"), (313, "the " * 200), (314, "the " * 180), (315, "x " + "the " * 30 + "y")]
    rows += [(320, None), (321, ""), (322, " \n\t "), (323, None), (None, passage), (None, None), (None, base), (330, base), (330, base), (331, passage)]
    rows += [(340, sentence(rng, 30_000)), (341, "é" * 500), (342, "l1\nl2\nl3\nl4"), (343, "l0\nl1\nl2\nl3\nl9"), (344, "r\n" * 9)]
    return rows


def frame(spark, rows, columns="doc_id long, text string", extra=True):
    """A table of ``rows`` with columns of clashing names besides."""
    df = spark.createDataFrame(rows, columns).repartition(5)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}) if extra else df


def words(text, lower=False):
    raw = (text or "").encode()
    return (re.sub(rb"[A-Z]+", lambda m: m[0].lower(), raw) if lower else raw).split()


def shingles(text, size=5):
    w = words(text, lower=True)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, threshold=85):
    """doc_id -> smallest linked doc_id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(rows, size=13):
    """Row by row: (n_words, n_removed, hash of the kept words)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def without_lines(rows, size=3):
    first = {}
    lines = [(i, t.split("\n") if t else []) for i, t in rows]
    for i, own in lines:
        for k in range(len(own) - size + 1):
            if i is not None:
                key = tuple(own[k:k + size])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, own in lines:
        gone, seen = [False] * len(own), set()
        for k in range(len(own) - size + 1):
            key = tuple(own[k:k + size])
            if key in seen or i is not None and first[key] < i:
                gone[k:k + size] = [True] * size
            seen.add(key)
        kept = "\n".join(x for x, g in zip(own, gone) if not g)
        out.append((i, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def exact(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def same(df, rows, columns):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(rows, key=repr)
