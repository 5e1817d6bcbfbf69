"""Search answered from a stored index of folded character trigrams.

One index belongs to one catalog snapshot. Texts are folded by the search
collation itself: every character of the snapshot that equals a printable
ASCII character under it stands for that one, characters that it ignores go,
and what else is not ASCII breaks a trigram. Postings are kept by blocks of
consecutive ids: a block in which a trigram of the term is missing is skipped
undecoded. Candidates are then compared with the term itself, so the answer is
that of a full scan; a term without a trigram is answered by the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.text import _SPELT_OUT, COLLATION, INSENSITIVE, _pieces, blank, clean_escapes
from cataloom.operators.joins import measured
from cataloom.operators.search import SEARCH_FIELDS, search
from cataloom.session import shuffle_partitions

#: Ids of one block of postings.
BLOCK_IDS = 1 << 12
#: Candidates up to this number are named in the filter of the catalog's scan;
#: more of them are met by a join.
NAMED_IDS = 5_000
_PRINTABLE = "".join(sorted({chr(c).lower() for c in range(0x20, 0x7F)}))
_USUAL = r"[\t\n\x0B\f\r\x20-\x7E]++"
_BATCH_BYTES = 2 << 20


def _characters(catalog: DataFrame) -> DataFrame:
    """The characters of the snapshot beyond printable ASCII, of which Unicode
    has a bounded number: char, to (what stands for it, empty if the collation
    ignores it, null if nothing does), odd (it may equal ASCII characters in
    a way that ``to`` doesn't say)."""
    found = None
    for c in SEARCH_FIELDS:
        rest = catalog.select(F.regexp_replace(c, _USUAL, "").alias("rest")).where("rest <> ''")
        own = rest.select(F.explode(F.array_distinct(F.split("rest", ""))).alias("char")).where("char <> ''").distinct()
        found = own if found is None else found.unionByName(own)
    char = F.collate("char", COLLATION)
    targets = [*_PRINTABLE, *_SPELT_OUT]
    equal = F.get(F.filter(F.array(*map(F.lit, targets)), lambda a: char == a), F.lit(0))
    to = F.when(char == F.lit(""), "").otherwise(equal)
    # ASCII characters come first in the collation, other scripts after them
    odd = F.isnull("to") & (char <= F.lit("zzzz"))
    return found.distinct().withColumn("to", to).withColumn("odd", odd)


def _folded(c: Column, single: dict[str, str], several: dict[str, str]) -> Column:
    for char, spelt in sorted(several.items()):
        c = F.replace(c, F.lit(char), F.lit(spelt))
    kept = sorted(single, key=lambda x: (single[x] == "", x))
    if kept:  # what has no counterpart is removed
        c = F.translate(c, "".join(kept), "".join(single[x] for x in kept))
    return F.lower(c)


def _trigrams(batches):
    """(field, gram, block, n, lows) of the rows at hand: the ids of a block
    that have the gram, as offsets from its first one."""
    schema = pa.schema([("field", pa.int32()), ("gram", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("lows", pa.binary())])

    def posted(held):
        table = pa.Table.from_batches(held)
        ids = table.column(0).to_numpy()
        for field in range(1, table.num_columns):
            keys, grams = [], []
            for chunk, own in zip(table.column(field).chunks, np.split(ids, np.cumsum([len(x) for x in table.column(field).chunks])[:-1])):
                offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
                data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].astype(np.int32)
                if len(data) < 3:
                    continue
                row = np.repeat(np.arange(len(chunk)), np.diff(offsets))
                plain = (data >= 0x20) & (data < 0x7F)
                whole = plain[:-2] & plain[1:-1] & plain[2:] & (row[:-2] == row[2:])
                gram = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[whole]
                # the rows of a chunk and the trigrams in it, each pair once
                pair = np.unique(row[:-2][whole] << 24 | gram)
                keys.append(own[pair >> 24])
                grams.append(pair & 0xFFFFFF)
            if not keys:
                continue
            id_, gram = np.concatenate(keys), np.concatenate(grams)
            order = np.lexsort((id_, gram, id_ // BLOCK_IDS))
            id_, gram, block = id_[order], gram[order], id_[order] // BLOCK_IDS
            starts = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(block, prepend=block[:1] - 1) != 0))
            lows = (id_ - block * BLOCK_IDS).astype("<u2").tobytes()
            ends = [*starts[1:].tolist(), len(id_)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(starts), field - 1, np.int32)), pa.array(gram[starts].astype(np.int32)), pa.array(block[starts].astype(np.int64)),
                pa.array(np.diff([*starts.tolist(), len(id_)]).astype(np.int32)), pa.array([lows[2 * a:2 * b] for a, b in zip(starts.tolist(), ends)], pa.binary())], schema=schema)

    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * _BATCH_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += batch.nbytes * part.num_rows // batch.num_rows
            if size >= _BATCH_BYTES:
                yield from posted(held)
                held, size = [], 0
    if held:
        yield from posted(held)


class SearchIndex:
    """A written index: ``characters``, ``postings`` (by gram and block) and
    ``odd`` (ids that are always candidates) under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.characters, self.postings, self.odd = (spark.read.parquet(f"{folder}/{x}") for x in ("characters", "postings", "odd"))

    @classmethod
    def build(cls, catalog: DataFrame, folder: str) -> SearchIndex:
        """Write the index of a snapshot (id and the searched columns; null
        texts have no trigrams; ids may repeat)."""
        spark = catalog.sparkSession
        _characters(catalog).write.parquet(f"{folder}/characters")
        said = spark.read.parquet(f"{folder}/characters").where("to is not null or odd").collect()  # letters of Unicode, not data
        single = {r["char"]: r["to"] for r in said if r["to"] is not None and len(r["to"]) < 2}
        several = {r["char"]: r["to"] for r in said if r["to"] is not None and len(r["to"]) > 1}
        folded = catalog.select(F.col("id").cast("long").alias("id"), *[F.coalesce(_folded(F.col(c), single, several), F.lit("")).alias(c) for c in SEARCH_FIELDS])
        # written before it is dealt: finding the ranges would run the folding a second time
        posted = measured(folded.mapInArrow(_trigrams, "field int, gram int, block long, n int, lows binary"))
        (posted.repartitionByRange(shuffle_partitions(spark), "field", "gram", "block").sortWithinPartitions("field", "gram", "block")
         .write.option("compression", "zstd").parquet(f"{folder}/postings"))
        odd = "".join(sorted(r["char"] for r in said if r["odd"]))
        has = F.lit(False)
        for c in SEARCH_FIELDS if odd else ():
            has = has | F.coalesce(F.length(F.translate(c, odd, "")) < F.length(c), F.lit(False))
        catalog.where(has).select(F.col("id").cast("long").alias("id")).write.parquet(f"{folder}/odd")
        return cls(spark, folder)

    def _grams(self, term: str) -> set[int]:
        """Trigrams that every text with the term has once it is folded."""
        known: dict[str, str] = {}
        asked = sorted({c for c in term if not "\x20" <= c <= "\x7e"})
        if asked:
            known = {r["char"]: r["to"] for r in self.characters.where(F.col("char").isin(asked) & F.col("to").isNotNull()).collect()}
        out = set()
        for piece in _pieces(clean_escapes(term)):
            # a character that the snapshot lacks may still equal one that it has
            said = "".join(c if "\x20" <= c <= "\x7e" else known.get(c, "\0") for c in piece).lower()
            grams = (said[i:i + 3] for i in range(len(said) - 2))
            out |= {ord(a) << 16 | ord(b) << 8 | ord(c) for a, b, c in grams if all("\x20" <= x <= "\x7e" for x in (a, b, c))}
        return out

    def candidates(self, terms: dict[str, str]) -> DataFrame | None:
        """Distinct ids that may match all ``terms`` (by column), or None if
        no term has a trigram."""
        asked = [(SEARCH_FIELDS.index(c), g) for c, term in terms.items() for g in sorted(self._grams(term))]
        if not asked:
            return None
        match = F.lit(False)
        for field in sorted({f for f, _ in asked}):
            match = match | ((F.col("field") == field) & F.col("gram").isin([g for f, g in asked if f == field]))
        lists = self.postings.where(match)
        full = lists.groupBy(F.col("block").alias("f_block")).agg(F.count_distinct("field", "gram").alias("grams")).where(F.col("grams") == len(asked))
        open_ = lists.join(measured(full.select("f_block")), F.col("block") == F.col("f_block"), "left_semi")
        ids = (open_.mapInArrow(_ids, "id long, key long").groupBy("id").agg(F.count_distinct("key").alias("grams"))
               .where(F.col("grams") == len(asked)).select("id"))
        return ids.unionByName(self.odd).distinct()

    def search(self, catalog: DataFrame, name: str | None = None, class_: str | None = None, prompt: str | None = None,
               file_name: str | None = None, collation: str = INSENSITIVE) -> DataFrame:
        """``search`` of the snapshot that the index was built of, reading
        only rows that may match."""
        given = {"name": name, "class": class_, "prompt": prompt, "file_name": file_name}
        terms = {c: t for c, t in given.items() if not blank(t)}
        found = self.candidates(terms)
        if found is not None:
            found = measured(found)
            named = [r["id"] for r in found.limit(NAMED_IDS + 1).collect()]
            if len(named) <= NAMED_IDS:
                catalog = catalog.where(F.col("id").isin(named)) if named else catalog.where(F.lit(False))
            else:
                catalog = catalog.join(found.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left_semi")
        return search(catalog, name, class_, prompt, file_name, collation)


def _ids(batches: Iterable[pa.RecordBatch]):
    """(id, key of field and gram) of posting lists."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            lows = [np.frombuffer(x, "<u2").astype(np.int64) for x in part.column(part.schema.get_field_index("lows")).to_pylist()]
            field, gram, block = (part.column(part.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("field", "gram", "block"))
            n = list(map(len, lows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lows) + np.repeat(block * BLOCK_IDS, n)), pa.array(np.repeat(field << 24 | gram, n))],
                                             names=["id", "key"])
