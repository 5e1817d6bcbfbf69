"""Repeated lines by overlapping windows of three lines.

Each text offers the hash of every three consecutive lines. Windows that
occur twice are found over the whole corpus; every occurrence but the first
is marked, and the lines that marked windows cover go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import dealt, stored, texts
from cataloom.llm.words import chunks

LINES = 3


def _lines(text: str) -> list[bytes]:
    return text.encode().split(b"\n") if text else []


_WINDOW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("again", pa.bool_())])


def _windows(batches):
    """Every window of a text, and whether the text had it before."""
    for rows, _, _ in chunks(batches):
        ids, tags, at, names, again = [], [], [], [], []
        for doc, text, tag in zip(*(rows.column(i).to_pylist() for i in range(3))):
            lines = [hashlib.blake2b(x, digest_size=16).digest() for x in _lines(text)]
            seen: set[bytes] = set()
            for i in range(len(lines) - LINES + 1):
                name = hashlib.blake2b(b"".join(lines[i:i + LINES]), digest_size=16).digest()
                ids.append(doc)
                tags.append(tag)
                at.append(i)
                names.append(name)
                again.append(name in seen)
                seen.add(name)
        halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(at, pa.int32()),
                                          pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(again, pa.bool_())], schema=_WINDOW)


def _cut(with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def cut(batches):
        for rows, _, _ in chunks(batches):
            out = {k: [] for k in schema.names}
            for doc, text, marked in zip(*(rows.column(i).to_pylist() for i in range(3))):
                lines = _lines(text)
                depth = np.zeros(len(lines) + LINES + 1, np.int64)
                first = np.unique(np.array(marked or [], np.int64))
                depth[first] += 1
                depth[first + LINES] -= 1
                stays = np.cumsum(depth)[:len(lines)] == 0
                kept = b"\n".join([x for x, s in zip(lines, stays.tolist()) if s])
                for k, v in zip(out, (doc, len(lines), len(lines) - int(stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)
    return cut


def line_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines,
    n_removed, kept_sha256, and kept_text if ``with_text``.

    Lines are what newlines separate; a null or empty text has none. A window
    of three consecutive lines whose lines equal those of an earlier window
    (smaller doc_id, or the same text further up) is a later occurrence, and
    the lines it covers go; overlapping windows cover their union. Windows
    are judged on the input and compared by 128-bit hashes.

    A text under a null doc_id only loses what it repeats itself. Rows that
    repeat a doc_id don't remove each other's lines. Texts of fewer than
    three lines stay. Other columns are ignored; an empty table gives no rows.
    """
    tagged = texts(docs).withColumn("tag", F.xxhash64("text"))
    found = stored(tagged.mapInArrow(_windows, "doc_id long, tag long, at int, h1 long, h2 long, again boolean"))
    repeated = stored(found.where("doc_id is not null").groupBy(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
                      .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("r1", "r2", "first"))
    later = found.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where("doc_id > first")
    marked = (later.select("doc_id", "tag", "at").unionByName(found.where("again").select("doc_id", "tag", "at"))
              .groupBy(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag")).agg(F.collect_set("at").alias("marked")))
    out = (tagged.join(dealt(stored(marked)), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tag") == F.col("m_tag")), "left")
           .select("doc_id", "text", "marked")
           .mapInArrow(_cut(with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string"))
    return out if with_text else out.drop("kept_text")
