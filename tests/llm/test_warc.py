"""Merkle audits against a record-by-record comparison."""

import hashlib
import random

import support
from cataloom.llm import warc_fixity

SCHEMA = "archive long, offset long, length long, digest string"


def plain(own, other):
    from collections import defaultdict
    sides = [defaultdict(list) for _ in range(2)]
    for side, rows in zip(sides, (own, other)):
        for a, o, n, d in rows:
            side[a, -1 if o is None else o].append(f"{n}:{d}")
    out = []
    for key in set(sides[0]) | set(sides[1]):
        x, y = ("\n".join(sorted(s[key])) if key in s else None for s in sides)
        if x != y:
            out.append((*key, "changed" if x and y else "missing" if x else "extra"))
    return out


def replicas():
    rng = random.Random(6)
    own = []
    for archive in (0, 1, 2, -5, None):
        at = 0
        for _ in range(rng.randrange(50, 400)):
            n = rng.choice([10, 3000, 200_000])
            own.append((archive, at, n, hashlib.sha256(str(rng.random()).encode()).hexdigest()))
            at += n
    own += [own[3], own[3], (1, None, 5, "d"), (2, 10**9, 5, "far")]
    other = list(own)
    for _ in range(25):
        i = rng.randrange(len(other))
        a, o, n, _ = other[i]
        other[i] = (a, o, n, "bad") if rng.random() < 0.6 else (a, 1 + (o or 0), n, "moved")
    del other[40:44]
    return own, other + [(9, 0, 1, "new archive"), own[10]]


def test_audit(spark):
    own, other = replicas()
    a, b = (support.frame(spark, rows, SCHEMA, extra=False).withColumnsRenamed({}) for rows in (own, other))
    support.same(warc_fixity.audit(a, b), plain(own, other), ["archive", "offset", "kind"])
    assert warc_fixity.audit(a, a).collect() == []


def test_empty_sides(spark):
    own, _ = replicas()
    a, none = support.frame(spark, own, SCHEMA, extra=False), support.frame(spark, [], SCHEMA, extra=False)
    support.same(warc_fixity.audit(a, none), plain(own, []), ["archive", "offset", "kind"])
    support.same(warc_fixity.audit(none, a), plain([], own), ["archive", "offset", "kind"])
    assert warc_fixity.audit(none, none).collect() == []


def test_records(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (None, None, None), (2, None, ""), (2, "http://b/", None), (2500, "x", "y" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = {(r.page_id, bytes(r.record)) for r in warc_fixity.warc_records(pages).collect()}
    assert (1, "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: http://a/\r\n"
               "Content-Type: text/html\r\nContent-Length: 9\r\n\r\n<p>é</p>\r\n\r\n".encode()) in records
    found = warc_fixity.placed(warc_fixity.leaves(warc_fixity.warc_records(pages))).collect()
    assert len(found) == 5 and {r.offset for r in found if r.page_id == 2} == {min(r.offset for r in found if r.page_id == 2), max(r.offset for r in found if r.page_id == 2)}
    for r in found:
        assert any(p == r.page_id and len(b) == r.length and hashlib.sha256(b).hexdigest() == r.digest for p, b in records)
