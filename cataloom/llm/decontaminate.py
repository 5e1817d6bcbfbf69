"""Benchmark items inside documents: MinHash containment search by size.

Under one hash order, an item of n distinct shingles of which at least
``need`` must be in a document shares one of its n - need + 1 smallest
hashes with it. That many of its smallest hashes are the item's sketch; how
many depends on its size, so items are partitioned by size (powers of two)
and each partition has the largest hash of its sketches as bound. A document
offers its shingles below the bound to the sketches; a pair that meets, and
whose document is large enough to hold the item, is verified on the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import dealt, stored, texts

SHINGLE = 5
CONTAINED = 80
#: Rows of sketches, and characters of items, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_CHARS = 1 << 20, 32 << 20


def _worded(rows: DataFrame, least: int = SHINGLE) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return rows.select(*[c for c in rows.columns if c != "text"], words.alias("words")).where(F.size("words") >= least)


def _hashes():
    of = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE)])
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), of))


def _shingles(size: int = SHINGLE):
    of = lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(size)])
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - size), of))


def _named(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()


def contained_items(docs: DataFrame, items: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """Pairs of a document (doc_id, text) and an item (item_id, text) of
    which it holds at least ``percent`` of the distinct shingles:
    doc_id, tag (a hash of the text), item_id, n_item, n_found, containment.
    Shingles are of five words; an item of one to four words is one shingle,
    its whole word sequence.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased whole text, however
    long. Null texts and texts without words have no shingles and are in no pair. A null doc_id or item_id is reported as null; rows that repeat a doc_id
    and text, or an item_id and text, give a pair once. Other columns are
    ignored; an empty table on either side gives no rows.
    """
    whole, one = F.lit(1.0), F.lit(1).cast("long")
    short = short_items(docs, items).select("*", one.alias("n_item"), one.alias("n_found"), whole.alias("containment"))
    return _shingled_items(docs, items, percent).unionByName(short)


def _shingled_items(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """``contained_items`` for items of five words and more."""
    worded = stored(_worded(_named(items).withColumn("item", F.xxhash64("item_id", "text"))).select("item_id", "item", _hashes().alias("hashes"), _shingles().alias("shingles")))
    need = F.ceil(F.size("shingles") * percent / 100).cast("int")
    sized = worded.select("item_id", "item", "hashes", "shingles", need.alias("need"), F.floor(F.log2(F.size("shingles"))).alias("size_class"))
    lowest = F.slice(F.array_sort("hashes"), F.lit(1), F.size("hashes") - F.col("need") + 1)
    sketches = stored(sized.select("item", "need", "size_class", F.explode(lowest).alias("hash")))
    bounds = {r["size_class"]: r for r in sketches.groupBy("size_class").agg(F.max("hash").alias("bound"), F.min("need").alias("need")).collect()}  # at most 64 rows

    keyed = texts(docs).withColumn("tag", F.xxhash64("text"))
    if not bounds:
        none = {"item_id": dict(items.dtypes)["item_id"], "n_item": "long", "n_found": "long", "containment": "double"}
        return keyed.where("false").select("doc_id", "tag", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    hashed = _worded(keyed).select("doc_id", "tag", _hashes().alias("hashes"))
    # the partitions whose items the document can hold give the bound for its shingles
    bound = F.greatest(*[F.when(F.size("hashes") >= r["need"], F.lit(r["bound"])) for r in bounds.values()], F.lit(-2**63).cast("long"))
    offered = hashed.select("doc_id", "tag", F.size("hashes").alias("n_doc"), F.explode(F.filter("hashes", lambda h: h <= bound)).alias("offered"))
    small = sketches.count() <= BROADCAST_ROWS
    met = offered.join(F.broadcast(sketches) if small else sketches, (F.col("offered") == F.col("hash")) & (F.col("n_doc") >= F.col("need")))
    pairs = stored(met.select(F.col("doc_id").alias("c_id"), F.col("tag").alias("c_tag"), "item").distinct())

    suspects = pairs.groupBy("c_id", "c_tag").agg(F.collect_list("item").alias("candidates"))
    held = (_worded(keyed.join(stored(suspects), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag"))).select("doc_id", "tag", "candidates", "text"))
            .select("doc_id", "tag", "candidates", _shingles().alias("held")).select("doc_id", "tag", "held", F.explode("candidates").alias("candidate")))
    exact = sized.select("item_id", "item", "need", "shingles")
    small = (worded.agg(F.sum(F.length(F.array_join("shingles", " ")))).first()[0] or 0) <= BROADCAST_CHARS
    found = held.join(F.broadcast(exact) if small else exact, F.col("candidate") == F.col("item")).withColumn(
        "n_found", F.size(F.array_intersect("shingles", "held"))).where("n_found >= need")
    return found.select("doc_id", "tag", "item_id", F.size("shingles").cast("long").alias("n_item"), F.col("n_found").cast("long").alias("n_found"),
                        (F.col("n_found") / F.size("shingles")).alias("containment")).distinct()


def short_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and an item of one to four words that it holds:
    doc_id, tag, item_id. The item's word sequence is its one shingle, met by
    the documents' runs of as many words; words, nulls and repeats are as in
    ``contained_items``.
    """
    named = stored(_worded(_named(items), 1).where(F.size("words") < SHINGLE)
                   .select("item_id", F.size("words").alias("size"), F.array_join("words", " ").alias("phrase")))
    sizes = sorted(r["size"] for r in named.select("size").distinct().collect())  # four at most
    keyed = texts(docs).withColumn("tag", F.xxhash64("text"))
    if not sizes:
        return keyed.where("false").select("doc_id", "tag", F.lit(None).cast(dict(items.dtypes)["item_id"]).alias("item_id"))
    phrases = stored(named.select(F.col("phrase").alias("wanted")).distinct())
    small = named.count() <= BROADCAST_ROWS and (named.agg(F.sum(F.length("phrase"))).first()[0] or 0) <= BROADCAST_CHARS
    runs = F.flatten(F.array(*[F.when(F.size("words") >= n, _shingles(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    said = _worded(keyed, 1).select("doc_id", "tag", F.explode(runs).alias("phrase"))
    met = said.join(F.broadcast(phrases) if small else phrases, F.col("phrase") == F.col("wanted"), "left_semi").distinct()
    return met.join(F.broadcast(named) if small else named, "phrase").select("doc_id", "tag", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Rows
    go or stay by their own doc_id (null too) and text."""
    pairs = contained_items(docs, items, percent).select("doc_id", "tag")
    bad = stored(pairs.select(F.col("doc_id").alias("_leak_id"), F.col("tag").alias("_leak_tag")).distinct())
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(dealt(bad), docs["doc_id"].cast("long").eqNullSafe(bad["_leak_id"]) & (own == bad["_leak_tag"]), "left_anti")
