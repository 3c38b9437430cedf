"""An exact histogram of encoded lengths, and the token totals it answers for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.llm.rows import prefix_sums
from chronotape.plans.shared import written


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length (column n_tokens): documents, and sums over shorter and longer documents.

    Columns: n_tokens, documents, tokens (of this length), documents_longer, tokens_longer (lengths above),
    documents_shorter, tokens_shorter (below), truncated_total (tokens left when every document is cut at
    this length), quantile (share of documents of this length or less). A null length is 0. Documents are
    counted before anything is ordered; the sums run over the distinct lengths. Empty in, empty out.
    """
    counted = lengths.groupBy(F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens")).agg(
        F.count(F.lit(1)).alias("documents")
    )
    counted = written(counted.withColumn("tokens", F.col("n_tokens") * F.col("documents")), "lengths")
    rows, totals = prefix_sums(counted, ["n_tokens"], {"documents_shorter": "documents", "tokens_shorter": "tokens"})
    total = totals.first()
    documents, tokens = (total["documents_shorter"] or 0, total["tokens_shorter"] or 0) if total else (0, 0)
    up_to = F.col("documents_shorter") + F.col("documents")
    return rows.select(
        "n_tokens",
        "documents",
        "tokens",
        (F.lit(documents) - up_to).alias("documents_longer"),
        (F.lit(tokens) - F.col("tokens_shorter") - F.col("tokens")).alias("tokens_longer"),
        "documents_shorter",
        "tokens_shorter",
        (F.col("tokens_shorter") + F.col("n_tokens") * (F.lit(documents) - F.col("documents_shorter"))).alias("truncated_total"),
        (up_to / F.lit(max(1, documents))).alias("quantile"),
    )


def truncated_total(counts: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at `limit`, any limit, from the histogram alone."""
    left = F.when(F.col("n_tokens") <= limit, F.col("tokens")).otherwise(F.col("documents") * limit)
    return counts.agg(F.coalesce(F.sum(left), F.lit(0))).first()[0]


def quantile(counts: DataFrame, share: float) -> int | None:
    """The least length that this share of the documents does not exceed; null without documents."""
    return counts.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]
