"""Exact duplicates by a Golomb-coded fingerprint exchange.

Parts of the corpus send their sorted fingerprints, Golomb-coded, to the
owners of fingerprint ranges and receive bitmaps of duplicates
(``exchange.ask``). Only rows under a duplicate fingerprint are suspects;
their whole texts are shuffled and compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.exchange import answer_bits, ask
from cataloom.llm.tables import stored, texts

U = np.uint64
#: Rows that share one list of fingerprints: bounds a task's memory.
PART_ROWS = 1 << 19
FINGERPRINT_BITS = 48
_SPACE = r"[\x20\x09-\x0D]+"


def _pack(batches):
    """One row for each part: its distinct fingerprints, and its rows as an
    Arrow stream."""
    held, rows, seq = [], 0, 0
    first = TaskContext.get().partitionId() << 32

    def part():
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        keys = np.unique(table.column("fp").to_numpy().astype(U))
        return pa.RecordBatch.from_pydict({"part": [first + seq], "keys": [keys.tobytes()], "rows": [sink.getvalue().to_pybytes()]},
                                          pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary())]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= PART_ROWS:
            yield part()
            held, rows, seq = [], 0, seq + 1
    if held:
        yield part()


def _unpack(batches):
    """The rows of each part, with whether the fingerprint occurs twice."""
    for batch in batches:
        for keys, rows, answers in zip(*(batch.column(c).to_pylist() for c in ("keys", "rows", "answers"))):
            table = pa.ipc.open_stream(rows).read_all()
            at = np.searchsorted(np.frombuffer(keys, U), table.column("fp").to_numpy().astype(U))
            twice = (np.bincount(at) > 1) | answer_bits(answers)
            out = table.select(["doc_id", "tag", "sha"]).append_column("suspect", pa.array(twice[at]))
            yield from out.to_batches()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256, tag (a hash of the unchanged text).

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` is
    replaced by one space; a null text counts as empty, and empty texts are
    equal to each other. keep_id is the smallest doc_id of the group; rows
    with a null doc_id count in group_size but never stay if another row does
    (a group of null ids only has keep_id null and kept false). Rows that
    repeat a doc_id and its text are all of the group, and all have kept
    true if that id stays. Other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    plain = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), F.regexp_replace("text", _SPACE, " ").alias("norm"))
    prints = stored(plain.select(
        "doc_id", "tag", F.shiftrightunsigned(F.xxhash64("norm"), 64 - FINGERPRINT_BITS).alias("fp"), F.sha2("norm", 256).alias("sha")))
    total = prints.count()
    parts = stored(prints.mapInArrow(_pack, "part long, keys binary, rows binary"))
    rows = stored(parts.join(ask(parts, FINGERPRINT_BITS, total), "part").select("keys", "rows", "answers")
                  .mapInArrow(_unpack, "doc_id long, tag long, sha string, suspect boolean"))
    suspects = stored(rows.where("suspect").select(F.col("doc_id").alias("suspect_id")).distinct())
    groups = stored(plain.join(suspects, F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
                    .groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                    .where("group_size > 1").select(F.sha2("norm", 256).alias("group_sha"), "keep_id", "group_size"))
    alone = rows.where("not suspect").select("doc_id", "tag", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    several = (rows.where("suspect").join(groups, F.col("sha") == F.col("group_sha"), "left")
               .select("doc_id", "tag", F.when(F.col("group_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                       F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "sha"))
    return alone.unionByName(several).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"), "tag")
