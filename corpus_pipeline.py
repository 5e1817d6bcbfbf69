"""From raw documents to encoded training text, in five stages.

Each stage takes the documents that the one before has kept and is written
as Parquet before the next one reads it. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.decontaminate import decontaminate
from cataloom.llm.exact_dedup import exact_dedup
from cataloom.llm.near_dedup import near_dedup
from cataloom.llm.sentencepiece_nbest import encode_nbest
from cataloom.llm.tables import dealt, stored
from cataloom.llm.toxicity import score_toxicity
from cataloom.session import ensure_checkpoint_dir, ship_package

#: Similarity in percent from which documents are near copies (op10 has a contract of its own).
NEAR = 80


def _at(docs: DataFrame, keys: DataFrame):
    """Whether a document has one of the keys (doc_id, tag: a hash of its text)."""
    tag = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs["doc_id"].cast("long").eqNullSafe(keys["k_id"]) & (tag == keys["k_tag"])


def _keys(rows: DataFrame) -> DataFrame:
    return stored(rows.select(F.col("doc_id").alias("k_id"), F.col("tag").alias("k_tag")).distinct())


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    gone = _keys(rows)
    return docs.join(dealt(gone), _at(docs, gone), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays, once (of
    texts under null ids only, every row stays: nothing tells them apart)."""
    judged = stored(exact_dedup(docs))
    left = _without(docs, judged.where("not kept and keep_id is not null"))
    twice = _keys(judged.where("kept and group_size > 1").groupBy("doc_id", "tag").count().where("count > 1"))
    if twice.isEmpty():
        return left
    own = "_tag"
    while own in map(str.lower, docs.columns):  # a name that no column of the documents has
        own += "_"
    tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    once = left.join(twice, _at(left, twice), "left_semi").withColumn(own, tag).dropDuplicates(["doc_id", own]).drop(own)
    return left.join(twice, _at(left, twice), "left_anti").unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (of similarity 0.8 or more)
    stays: the smallest doc_id."""
    return _without(docs, near_dedup(docs, threshold=NEAR).where("not kept and component_id is not null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, however short it is."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, and the scores of the N best."""
    return encode_nbest(docs, with_ids=1).withColumn("ids", F.get("ids", 0))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL has no means to fit the first stage's classifier or to search a piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
