"""Corpus preparation: toxicity, language ID, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import exact_dedup, language_id, packing, shingles, simhash, toxicity
from docweave.llm.common import scratch


#: Rows that a Python worker gets at a time: whole texts, of which Spark's 10,000 take too much memory beside the heap.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_ROWS``, if they are larger or have no bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null and empty texts have no voter's hit, score low and stay; repeated
    rows get equal scores. Without a document or a label of each class all
    score alike, low, and stay. Null ids are never held out of learning, as
    labels need an id.
    """
    bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.held_out("doc_id", 4, 2))
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score_of(model, F.col("text")) < toxicity.THRESHOLD)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a learned language.

    Null, empty and letterless texts score 0 and go, as do all if no row has
    a language to learn from. Repeated rows go or stay together.
    """
    bounded(spark)
    profiles = language_id.fit_profiles(docs.where(~language_id.held_out("doc_id", 3, 1)))
    return docs.where(language_id.language_of(profiles, F.col("text"))["score"] >= language_id.LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of equal texts.

    Null counts as empty, and empty texts equal each other. Null ids come
    last; of rows equal in id and text one stays. No rows give no rows.
    """
    bounded(spark)
    return exact_dedup.keep_rows(docs, exact_dedup.dedup(docs), "sha", exact_dedup.digest_of(F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by fingerprints or by 5-word shingles.

    Null, empty and blank texts have fingerprint 0 and are one group, but
    share no shingles. Null ids come last; of repeated rows one stays. No
    rows give no rows.
    """
    bounded(spark)
    return simhash.keep_one(docs, similar=shingles.SIMILAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents and their places in sequences of at most 2048 tokens.

    Null and empty texts are the end token alone. Repeated rows and null ids
    are packed one by one. No rows give no rows.
    """
    bounded(spark)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, carry={"ids_crc32": F.crc32("ids")})
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Language profiles, label model and packing can't be written in SQL.
ORACLE_SQL = None
