"""Sources mixed to target weights by weighted sampling without replacement inside each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.llm.rows import SPACE, apply_copies, prefix_sums, row_key

#: A source is repeated at most this often.
MOST_EPOCHS = 3


def uniform(seed: str, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the row alone: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in the order of code points, null last, weigh 1, 2, ... `cycle`, repeating, and share the words of
    the whole table. No target exceeds MOST_EPOCHS times its source; what is cut off goes to the others by
    weight until all hold. Sorted by the level at which a source is full, the full ones are a prefix: the
    common level is what they leave, over the weight of the others. Only sources are ordered in one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", ((F.row_number().over(ordered) - 1) % cycle + 1).cast("bigint"))
    full = F.lit(MOST_EPOCHS) * F.col("source_size")
    leveled = weighted.withColumn("full", full).withColumn("full_at", F.col("full") / F.col("weight"))
    everything = Window.partitionBy()
    rising = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    shared = leveled.select(
        "source",
        "source_size",
        "weight",
        "full",
        "full_at",
        F.sum("source_size").over(everything).alias("all_words"),
        (F.sum("full").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("full_before"),
        F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    ).withColumn("level", (F.col("all_words") - F.col("full_before")) / F.col("weight_left"))
    # The common level is that of the first source, in this order, that stays below its limit.
    shared = shared.withColumn("place", F.row_number().over(rising))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)["level"]
    return shared.withColumn("common", level).select(
        "source",
        "source_size",
        F.least(F.col("full").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("full").cast("double"))).alias(
            "target"
        ),
    )


def mix(docs: DataFrame, quality: DataFrame, seed: str = "mix", cycle: int = 3) -> DataFrame:
    """For every row: doc_id, size, source_size, target, copies, taken, and its row key.

    `quality` holds doc_id and weight, a positive number; a document without one weighs 1 (of several, the
    largest counts). Each document draws an exponential key, -ln(u) / weight. A source's target holds so many
    complete epochs; the rest of it goes to the documents of the smallest keys, as many as bring the words
    taken nearest to the target. The order is cut by prefix sums, so no source is sorted in one task. A null
    or blank text has size 0; such documents are taken with the epochs and add no words. The draw depends on
    seed, doc_id and size only: reruns agree, and of rows equal in these the smaller checksum comes first.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    key_id, key_text = row_key(docs)
    sizes = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        words.cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("checksum"),
        key_id.alias("key_id"),
        key_text.alias("key_text"),
    )
    weights = (
        quality.where("doc_id is not null and weight > 0 and not isnan(weight)")
        .groupBy("doc_id")
        .agg(F.max(F.col("weight").cast("double")).alias("quality_weight"))
    )
    keyed = sizes.join(weights, "doc_id", "left").select(
        *sizes.columns,
        (-F.log(uniform(seed, "doc_id", "size")) / F.coalesce(F.col("quality_weight"), F.lit(1.0))).alias("draw"),
    )
    rows, totals = prefix_sums(keyed, ["draw", "doc_id", "checksum"], {"size_before": "size"}, ("source",))
    targets = source_targets(totals.withColumnRenamed("size_before", "size"), cycle)
    marked = targets.select(F.col("source").alias("of"), "source_size", "target")
    joined = rows.join(marked, F.col("source").eqNullSafe(F.col("of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    # A document at the cut is taken when at least half of it fits.
    again = F.col("size_before") + F.col("size") / F.lit(2.0) <= rest
    return (
        joined.withColumn("epochs", epochs.cast("bigint"))
        .withColumn("copies", (F.col("epochs") + F.when((F.col("epochs") < MOST_EPOCHS) & (F.col("size") > 0) & again, 1).otherwise(0)))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.col("copies").cast("bigint").alias("copies"),
            (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
            "key_id",
            "key_text",
        )
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from marks: 2 for good documents, 0.5 for poor ones; the rest have none and weigh 1."""
    return labels.where("quality is not null").select(
        "doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight")
    )


def mixture(docs: DataFrame, quality: DataFrame, seed: str = "mix", cycle: int = 3) -> DataFrame:
    """The documents of the mix, whole rows, each as often as it is taken."""
    return apply_copies(docs, mix(docs, quality, seed, cycle).select("key_id", "key_text", "copies"))
