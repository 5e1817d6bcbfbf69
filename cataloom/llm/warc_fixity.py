"""Fixity audit of WARC archives by Merkle trees.

A record's leaf is the hash of its bytes. Leaves are gathered by ordered
ranges of offsets within their archive, ranges by larger ranges, up to one
root for each archive; a range's hash covers its children's places and
hashes, so a missing record changes its own ranges only. An audit compares
the roots of two replicas and descends into the children of mismatching
nodes alone, down to the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import stored

#: Bytes of offsets that a lowest range spans, and children of a higher one.
LEAF_SPAN, FANOUT = 1 << 16, 16
#: Consecutive page_ids that go into one archive.
ARCHIVE_PAGES = 1000


def warc_records(pages: DataFrame, html=None) -> DataFrame:
    """``pages`` (page_id, url, html) as WARC/1.1 resource records: page_id,
    archive, record (bytes). A null url is written as empty, a null html as
    an empty block, a null page_id as ``none``; such pages are spread over
    archives of their own by url, since no id places them."""
    block = F.coalesce((F.col("html") if html is None else html).cast("string"), F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "),
                    F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    archive = F.coalesce(F.floor(F.col("page_id") / ARCHIVE_PAGES), -1 - F.pmod(F.xxhash64("url"), F.lit(1 << 20))).cast("long")
    return pages.select("page_id", archive.alias("archive"), F.encode(F.concat(head, block, F.lit("\r\n\r\n")), "UTF-8").alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """(page_id, archive, length, digest) of records; the bytes stay behind."""
    return records.select("page_id", "archive", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def placed(leaf: DataFrame) -> DataFrame:
    """Leaves with the offsets of records written one after another in the
    order of page_id, length and digest."""
    before = F.expr("sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, length, digest ROWS UNBOUNDED PRECEDING)")
    return leaf.select("page_id", "archive", (before - F.col("length")).alias("offset"), "length", "digest")


def _said(*columns: str):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def merkle(records: DataFrame) -> list[DataFrame]:
    """The trees of all archives of all replicas (side, archive, offset,
    length, digest), from the lowest ranges to the roots: tables (side,
    archive, node, digest)."""
    place = F.struct(F.col("offset").alias("place"), _said("offset", "length", "digest").alias("said"))
    low = (records.groupBy("side", "archive", F.floor(F.col("offset") / LEAF_SPAN).cast("long").alias("node"))
           .agg(F.sort_array(F.collect_list(place)).alias("children"))
           .select("side", "archive", "node", F.sha2(F.array_join("children.said", "\n"), 256).alias("digest")))
    levels = [stored(low)]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top:
        up = F.floor(F.col("node") / FANOUT).cast("long")
        child = F.struct(F.col("node").alias("place"), _said("node", "digest").alias("said"))
        above = (levels[-1].groupBy("side", "archive", up.alias("node")).agg(F.sort_array(F.collect_list(child)).alias("children"))
                 .select("side", "archive", "node", F.sha2(F.array_join("children.said", "\n"), 256).alias("digest")))
        levels.append(stored(above))
        top //= FANOUT
    return levels


def _differing(nodes: DataFrame, *keys: str) -> DataFrame:
    """Keys whose digest differs between the sides or is on one side only."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest")))
    return nodes.groupBy(*keys).agg(of(0).alias("own"), of(1).alias("other")).where("NOT (own <=> other)")


def audit(own: DataFrame, other: DataFrame) -> DataFrame:
    """Records (archive, offset, length, digest) in which two replicas
    differ: archive, offset, kind (changed, missing, extra: seen from
    ``own``), own_digest, other_digest.

    Records that share an archive and offset are compared as one, by the
    hash over their sorted lengths and digests. Null archives are one
    archive; records without an offset are one record of it. Other columns
    are ignored; two empty replicas don't differ.
    """
    columns = [F.col("archive").cast("long").alias("archive"), F.coalesce(F.col("offset").cast("long"), F.lit(-1).cast("long")).alias("offset"), "length", "digest"]
    records = stored(own.select(F.lit(0).alias("side"), *columns).unionByName(other.select(F.lit(1).alias("side"), *columns)))
    levels = merkle(records)
    bad = stored(_differing(levels[-1], "archive", "node").select(F.col("archive").alias("b_archive"), F.col("node").alias("b_node")))
    for level in reversed(levels[:-1]):
        below = level.join(bad, F.col("archive").eqNullSafe(F.col("b_archive")) & (F.floor(F.col("node") / FANOUT) == F.col("b_node")), "left_semi")
        bad = stored(_differing(below, "archive", "node").select(F.col("archive").alias("b_archive"), F.col("node").alias("b_node")))
    open_ = records.join(bad, F.col("archive").eqNullSafe(F.col("b_archive")) & (F.floor(F.col("offset") / LEAF_SPAN) == F.col("b_node")), "left_semi")
    one = open_.groupBy("side", "archive", "offset").agg(F.array_join(F.sort_array(F.collect_list(_said("length", "digest"))), "\n").alias("digest"))
    kind = F.when(F.col("other").isNull(), "missing").when(F.col("own").isNull(), "extra").otherwise("changed")
    return _differing(one, "archive", "offset").select("archive", "offset", kind.alias("kind"), F.col("own").alias("own_digest"), F.col("other").alias("other_digest"))


def damaged_replica(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """A second replica of the archives of ``pages`` with faults that the
    page_id decides: 1 page in 97 has a character changed, 1 in 211 lost its
    end, 1 in 503 is missing. Records keep the offsets of the manifest."""
    html = (F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30)))
            .when(F.col("page_id") % 211 == 7, F.expr("left(html, length(html) - 10)")).otherwise(F.col("html")))
    found = leaves(warc_records(pages.where("page_id is null or page_id % 503 <> 11"), html))
    at = manifest.select(F.col("page_id").alias("m_id"), F.col("archive").alias("m_archive"), "offset")
    return (found.join(at, F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("archive") == F.col("m_archive")))
            .select("page_id", "archive", "offset", "length", "digest"))
