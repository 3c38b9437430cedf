"""Semantic keys: which physical field, from which source, means what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotape.functions.values import kind_of
from chronotape.operators.predicates import kind as type_is

# A registry row: (field, source or None for any, key, kind).
Entry = tuple[str, str | None, str, str]
SCHEMA = "field string, source string, key string, kind string"


def registry_table(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    return spark.createDataFrame([tuple(e) for e in entries], SCHEMA)


def stacked(tape: DataFrame, fields: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Wide to long: one row per present field value, with its kind and text."""
    types = dict(tape.dtypes)
    cells = [
        F.when(
            F.col(f).isNotNull(),
            F.struct(
                F.lit(f).alias("field"),
                F.lit(kind_of(types[f])).alias("vtype"),
                F.col(f).cast("string").alias("value"),
            ),
        )
        for f in fields
    ]
    # Absent cells are dropped after the explode, in generated code; a filter over the array is interpreted.
    return tape.select(*carried, F.explode(F.array(*cells)).alias("c")).filter("c is not null").select(*carried, "c.*")


def resolved(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Give every cell its key: the entry of its own source, else the one for any source.

    The registry is a declared table of a few rows whose size Spark cannot know: it is sent to the tasks, and the
    cells stay where they are.
    """
    own = registry.filter("source is not null").select("field", "source", F.col("key").alias("_key"), F.col("kind").alias("_kind"))
    common = registry.filter("source is null").select("field", F.col("key").alias("_any"), F.col("kind").alias("_any_kind"))
    return (
        cells.join(F.broadcast(own), ["field", "source"], "left")
        .join(F.broadcast(common), "field", "left")
        .withColumns({"key": F.coalesce("_key", "_any"), "kind": F.coalesce("_kind", "_any_kind")})
        .drop("_key", "_kind", "_any", "_any_kind")
    )


def unknown_pairs(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """(field, source) pairs of the data that no entry names."""
    pairs = cells.groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))
    return resolved(pairs, registry).filter("key is null").select("field", "source", "n")


def profile_change_values(tape: DataFrame, numeric: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """A profile change as two typed keys; a number that does not read becomes a note instead of a value."""
    sides = F.array(
        *[
            F.struct(F.concat(F.lit("profile_"), "field_name", F.lit(f"_{s}")).alias("key"), F.col(f"{s}_value").alias("text"))
            for s in ("old", "new")
        ]
    )
    rows = tape.filter(type_is("profile_change")).select(*carried, "field_name", F.explode(sides).alias("s"))
    number = F.col("field_name").isin(*numeric)
    read = F.col("s.text").try_cast("bigint")
    return rows.filter("s.text is not null").select(
        *carried,
        F.col("s.key").alias("key"),
        F.when(number, F.lit("int")).otherwise(F.lit("str")).alias("vtype"),
        F.when(number, read.cast("string")).otherwise(F.col("s.text")).alias("value"),
        F.when(number & read.isNull(), F.concat(F.lit("unreadable: "), F.col("s.text"))).alias("note"),
    )


def key_registry(registry: DataFrame, weight_rule: dict[str, str]) -> DataFrame:
    """One row per key: kind, how it is weighted, and the physical fields behind it."""
    rules = F.create_map(*[x for k, v in weight_rule.items() for x in (F.lit(k), F.lit(v))])
    source = F.coalesce("source", F.lit("*"))
    return registry.groupBy("key").agg(
        F.min("kind").alias("kind"),
        F.element_at(rules, F.min("kind")).alias("weight_rule"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", source, "field"))), ",").alias("fields"),
    )
