"""Typed values of a tape: their kind, their text, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.plans.split import number_rows, plan_split

# Kinds in their order, and the texts that read as true and false.
KIND_ORDER = {"bool": 0, "int": 1, "float": 2, "str": 3}
TRUE_TEXTS = ("true", "1", "yes")
FALSE_TEXTS = ("false", "0", "no")


def kind_of(dtype: str) -> str:
    """Value kind of a Spark column type."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if dtype in ("float", "double"):
        return "float"
    return "bool" if dtype == "boolean" else "str"


def value_text(value: Column) -> Column:
    """Text of a value that, with its kind, gives the value back."""
    return value.cast("string")


def as_declared(text: Column, dtype: str) -> Column:
    """Text read as a declared type; null when it does not read as one."""
    if dtype == "boolean":
        lowered = F.lower(F.trim(text))
        return F.when(lowered.isin(*TRUE_TEXTS), F.lit(True)).when(lowered.isin(*FALSE_TEXTS), F.lit(False))
    if dtype == "bigint":
        return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))
    return text.try_cast(dtype)


def kind_rank(vtype: Column) -> Column:
    rank = F.lit(len(KIND_ORDER))
    for name, place in KIND_ORDER.items():
        rank = F.when(vtype == name, F.lit(place)).otherwise(rank)
    return rank


def typed_places(values: DataFrame, keys: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """Place of each distinct (vtype, value): kinds in order, numbers as numbers, the rest as text."""
    number = F.when(F.col("vtype").isin("int", "float"), F.col("value").try_cast("double"))
    keyed = values.withColumn("_at", F.coalesce(number, text_number(F.col("value"))))
    inner = [*keys, "vtype"]
    numbered = number_rows(keyed, plan_split(keyed, inner, "_at"), ["value"], "_place")
    # At most four kinds per key stand before a kind.
    kinds = values.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(kind_rank(F.col("vtype"))).rowsBetween(Window.unboundedPreceding, -1)
    starts = kinds.select(*inner, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(starts, inner).select(
        *values.columns, (F.col("_start") + F.col("_place")).alias(name)
    )


def text_number(text: Column) -> Column:
    """The first six bytes as a number: texts in byte order never step back."""
    first = F.substring(F.encode(text, "utf-8"), 1, 6)
    return F.conv(F.rpad(F.hex(first), 12, "0"), 16, 10).cast("double")


def cost_groups(rows: DataFrame, cost: str, tie: str, groups: int) -> DataFrame:
    """Equal groups by ascending cost: rows, total, lowest and highest cost of each."""
    split = plan_split(rows, [], cost)
    placed = number_rows(rows, split, [tie], "_place")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    group = F.floor(F.col("_place") * groups / total).cast("bigint")
    return placed.groupBy(group.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cost).alias("cost"),
        F.min(cost).alias("lo"),
        F.max(cost).alias("hi"),
    )


