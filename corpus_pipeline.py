"""The corpus from raw documents to token ids: classify, drop copies, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All stages but the last return whole rows of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotape.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality_classifier
from chronotape.llm.rows import fresh
from chronotape.plans.shared import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, accepts.

    Null, empty and blank texts get the score of no features and go or stay together. Every row is judged by its
    text alone, so rows that are equal share their verdict and all stay or all go. Extra columns come along.
    """
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest, then the smallest doc_id, null ids last.

    Null, empty and blank texts are one text. Of rows that are equal in everything one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8 or more), the smallest doc_id.

    A text of fewer than five words is one shingle. Texts without words have no shingles and all stay.
    """
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a row taken twice stands twice.

    A null source is a source. Texts without words have no size and are not taken beyond whole epochs.
    """
    return mixing.mixture(docs, mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, and the digest of the bytes that they decode to: that of the text itself.

    Null and empty texts have no ids. The new columns are named ids and decoded_sha256, or the next free names.
    """
    ranks = byte_bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, scan=True)
    digest, = fresh(encoded, "decoded_sha256")
    decoded = byte_bpe.decode(encoded, ranks, encoded.columns[-1], digest)
    return decoded.withColumn(digest, F.sha2(F.col(digest), 256))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokens),
]

# Fitted weights and rank merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
