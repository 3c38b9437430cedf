"""Contiguous shards of near equal size, cut from global prefix sums of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.llm.rows import apply_copies, fresh, prefix_sums, row_key, shuffle_partitions


def shards(docs: DataFrame, count: int) -> DataFrame:
    """For every row: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot, and its row key.

    Documents stand in the order of doc_id (null ids last, then by checksum and size). A document belongs to
    the shard in which its middle byte falls when the bytes of the whole table are cut at `count` equal
    targets, so shards differ from the target by at most one document at either end. Slots count from 0
    without gaps. A null text has size 1 and checksum 0. Fewer documents than shards leave shards empty; an
    empty table gives an empty result; other columns are not read. Equal rows are interchangeable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key_id, key_text = row_key(docs)
    sizes = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key_id.alias("key_id"),
        key_text.alias("key_text"),
        F.lit(1).cast("bigint").alias("one"),
    )
    rows, totals = prefix_sums(sizes, ["doc_id", "text_crc32", "size"], {"bytes_before": "size", "rows_before": "one"})
    total = totals.first()
    total_bytes = int(total["bytes_before"] or 0) if total else 0
    middle = 2 * F.col("bytes_before") + F.col("size")
    placed = rows.withColumn(
        "shard", F.least(F.lit(count - 1), F.floor(middle * count / F.lit(max(1, 2 * total_bytes)))).cast("int")
    )
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row"))
    # One row per shard: `count` rows at most.
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("rows_before") - F.col("first_row")).alias("slot"),
        "key_id",
        "key_text",
    )


def write_shards(docs: DataFrame, path: str, count: int) -> None:
    """The documents themselves, whole rows, as `count` folders shard=0, shard=1, ... of Parquet, sorted by doc_id.

    One pass writes all shards; a shard that gets no document has no folder. If `docs` has a column shard,
    the folders are named by the next free name (_shard=0, ...). Null texts, null ids and repeated rows go
    where `shards` puts them, every row once. An empty table writes no shard.
    """
    name, = fresh(docs, "shard")
    mine = shards(docs, count).withColumn("copies", F.lit(1)).withColumnRenamed("shard", name)
    placed = apply_copies(docs, mine, (name,))
    ranged = placed.repartitionByRange(shuffle_partitions(docs), name, "doc_id").sortWithinPartitions(name, "doc_id")
    ranged.write.mode("overwrite").partitionBy(name).parquet(path)
