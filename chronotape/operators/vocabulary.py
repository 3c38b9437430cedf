"""The frozen vocabulary: specials, keys, category values, buckets and text pieces in one id space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotape.functions.values import typed_places
from chronotape.operators.corpus import bucket_table

# The special tokens with their ids, and the prefixes of token names.
SPECIALS = {"[PAD]": 0, "[UNK]": 1, "[MASK]": 2, "[EVT]": 3, "[USR]": 4}
PAD, UNK, MASK, EVT, USR = 0, 1, 2, 3, 4
KINDS = ("key", "value", "bucket", "bpe")


def key_ids(keys: DataFrame) -> DataFrame:
    """Ids of keys, in name order after the specials. Keys are a declared dimension of a few hundred rows."""
    place = F.row_number().over(Window.orderBy("key"))
    return keys.select("key").distinct().select("key", (place - 1 + len(SPECIALS)).cast("int").alias("id"))


def value_ids(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of category values: by key, then by typed order; they follow the keys."""
    placed = typed_places(counts.select("key", "vtype", "value").distinct(), ("key",), "_place")
    per_key = placed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_key.select("key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    first = keys.agg((F.max("id") + 1).alias("n")).scalar()
    return placed.join(starts, "key").select(
        "key", "vtype", "value", (first + F.col("_start") + F.col("_place")).cast("int").alias("id")
    )


def bucket_ids(scales: DataFrame, first: Column) -> DataFrame:
    """Scales with the id of their first bucket: keys by name, conditions by name with none last.

    There is one row per declared key and condition.
    """
    buckets = F.when(F.col("origin") == "none", F.lit(0)).otherwise(F.size("edges") + 1 + F.col("zero").cast("int"))
    before = Window.orderBy("key", F.col("cond").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return scales.withColumn("_n", buckets).select(
        *scales.columns, (first + start).cast("int").alias("first_id"), F.col("_n").cast("int").alias("n_buckets")
    )


def piece_ids(pieces: DataFrame, first: Column) -> DataFrame:
    """Text pieces (piece, local) continue the space by their place in the model."""
    return pieces.select("piece", (first + F.col("local")).cast("int").alias("id"))


@dataclass(frozen=True)
class Vocabulary:
    """Frozen tables of one training group."""

    keys: DataFrame
    values: DataFrame
    scales: DataFrame
    pieces: DataFrame | None = None

    def tokens(self, spark: SparkSession) -> DataFrame:
        """Every token with its id and name; a bucket carries its key, condition and place in the name."""
        specials = spark.createDataFrame(list(SPECIALS.items()), "token string, id int")
        keys = self.keys.select(F.concat(F.lit("key:"), "key").alias("token"), "id")
        values = self.values.select(
            F.concat(F.lit("value:"), "key", F.lit("="), "value").alias("token"), "id"
        )
        buckets = bucket_table(self.scales.drop("first_id", "n_buckets"))
        firsts = self.scales.select("key", F.col("cond").alias("_cond"), "first_id")
        named = buckets.join(
            firsts.withColumnRenamed("key", "_key"),
            F.col("key").eqNullSafe(F.col("_key")) & F.col("cond").eqNullSafe(F.col("_cond")),
        ).select(
            F.concat(F.lit("bucket:"), F.concat_ws("_", "key", "cond"), F.lit("_"), F.col("place").cast("string")).alias("token"),
            (F.col("first_id") + F.col("place")).cast("int").alias("id"),
        )
        out = specials.unionByName(keys).unionByName(values).unionByName(named)
        if self.pieces is not None:
            out = out.unionByName(self.pieces.select(F.concat(F.lit("bpe:"), "piece").alias("token"), "id"))
        return out


def token_kind(token: Column) -> Column:
    kind = F.when(token.startswith("["), F.lit("special"))
    for name in KINDS:
        kind = kind.when(token.startswith(f"{name}:"), F.lit(name))
    return kind


def short_name(token: Column) -> Column:
    """Readable name: a key, the value after '=', a bucket or a piece without its prefix."""
    after = F.substring(token, F.instr(token, ":") + 1, F.length(token))
    value = F.substring(after, F.instr(after, "=") + 1, F.length(after))
    kind = token_kind(token)
    return F.when(kind == "special", token).when(kind == "value", value).otherwise(after)


def summary(tokens: DataFrame) -> DataFrame:
    """Tokens per kind with their first and last id."""
    return tokens.groupBy(token_kind(F.col("token")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
