"""Exact copies found by merging sorted runs of digests up a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.llm.rows import SPACE, apply_copies, row_key
from chronotape.plans.shared import written

#: Runs that one merge takes in.
FAN_IN = 8


def digest_rows(docs: DataFrame) -> DataFrame:
    """Each document as the digest of its text without white space, its length and its row key; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key_id, key_text = row_key(docs)
    bare = docs.select(
        "doc_id",
        key_id.alias("key_id"),
        key_text.alias("key_text"),
        F.length(text).alias("n_chars"),
        F.regexp_replace(text, SPACE, "").alias("bare"),
    )
    return bare.select(
        "doc_id",
        "key_id",
        "key_text",
        "n_chars",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        # Two texts of one digest must also agree in length and in a second hash.
        F.length("bare").alias("bare_length"),
        F.xxhash64("bare").alias("bare_hash"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


IDENTITY = ["digest", "bare_length", "bare_hash"]


def merge_runs(rows: DataFrame, runs: int) -> DataFrame:
    """One row per text: the best document and the number of copies.

    Each partition's digests are one run. In every round, FAN_IN neighbouring runs exchange their digests
    and are merged; of equal digests the merge retains the best identifier and adds up the copies, so a
    text that fills a third of the table has at most FAN_IN rows per merge. The minimum of a structure is
    aggregated by sorting: each task merges its sorted inputs.
    """
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    merged = rows.groupBy(*IDENTITY, "run").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    while runs > 1:
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
            .groupBy(*IDENTITY, "run")
            .agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
        )
        runs = -(-runs // FAN_IN)
    return merged.drop("run")


def decisions(docs: DataFrame) -> DataFrame:
    """For every row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, and its row key.

    Texts are equal when they agree after all white space of [\\x20\\x09-\\x0D] is deleted; a null text is
    empty. Of equal texts the longest original stays, then the smallest doc_id, null ids last; of rows that
    are equal in all of that, one stays. An empty table gives an empty result; other columns are not read.
    """
    rows = written(digest_rows(docs), "digests")
    last = rows.agg(F.max("run")).first()[0]
    merged = written(merge_runs(rows, (last or 0) + 1), "copies")
    return rows.drop("run").join(merged, IDENTITY).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "key_id",
        "key_text",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, whole rows, columns as they came."""
    return apply_copies(docs, decisions(docs).select("key_id", "key_text", F.col("kept").cast("int").alias("copies")))
