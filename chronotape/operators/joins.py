"""Joins by key, by exact row and by interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.operators.asof import asof
from chronotape.plans.split import Measure, match, plan_split, running


def with_snapshot(rows: DataFrame, snapshot: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Snapshot fields next to each row; rows of unknown clients stay."""
    return rows.join(snapshot.select("client", *fields), "client", "left")


def with_family(rows: DataFrame, families: DataFrame) -> DataFrame:
    """The family of each row's product. The catalogue is small and Spark sends it to the tasks by its size."""
    return rows.join(families.select("product_id", "family"), "product_id", "left")


def known_clients(rows: DataFrame, clients: DataFrame) -> DataFrame:
    return rows.join(clients.select("client"), "client", "left_semi")


def without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(other.select(*keys), list(keys), "left_anti")


def match_marks(marks: DataFrame, raw: DataFrame, fields: Sequence[str], mark: str, row: str) -> DataFrame:
    """Each mark with the rows that equal it in every field: how many, and which one first."""
    pairs = match(marks.select(*fields, mark), raw.select(*fields, row), list(fields))
    return pairs.groupBy(mark).agg(F.count(row).alias("n_rows"), F.min(row).alias(row))


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str, vector: str, size: int, prefix: str = "usr") -> DataFrame:
    """Vector components as columns; a missing or repeated vector is for `vector_problems` to report."""
    return rows.join(vectors.select(key, F.col(vector).alias("_v")), key, "left").select(
        *rows.columns, *[F.get("_v", F.lit(i)).alias(f"{prefix}_{i}") for i in range(size)]
    )


def vector_problems(rows: DataFrame, vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows without exactly one vector of the declared length."""
    found = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"))
    problem = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "repeated")
        .when((F.col("least") != size) | (F.col("most") != size), "length")
    )
    return rows.select(key).join(found, key, "left").withColumn("problem", problem).filter("problem is not null").select(
        key, "problem"
    )


def counts_between(
    intervals: DataFrame, events: DataFrame, keys: Sequence[str], masks: dict[str, Column], row: str
) -> DataFrame:
    """How many masked events of the same key lie in [start, stop) of each interval.

    The number before `stop` minus the number before `start`: intervals and
    events meet in one ordered pass, and no pair of them is ever formed.
    """
    keys = list(keys)
    names = list(masks)
    ends = F.array(
        F.struct(F.col("start").alias("_at"), F.lit(-1).alias("_sign")),
        F.struct(F.col("stop").alias("_at"), F.lit(1).alias("_sign")),
    )
    probes = intervals.select(*keys, row, F.explode(ends).alias("e")).select(*keys, row, "e.*")
    offers = events.select(
        *keys, F.col("t").alias("_at"), *[F.coalesce(m, F.lit(False)).cast("bigint").alias(f"_m_{n}") for n, m in masks.items()]
    )
    both = probes.unionByName(offers, allowMissingColumns=True)
    measures = [Measure(f"_c_{n}", "sum", F.coalesce(F.col(f"_m_{n}"), F.lit(0))) for n in names]
    counted = running(both, plan_split(both, keys, "_at"), measures).filter("_sign is not null")
    sums = counted.groupBy(row).agg(*[F.sum(F.col("_sign") * F.col(f"_c_{n}")).alias(n) for n in names])
    return intervals.join(sums, row)


def first_after(rows: DataFrame, stops: DataFrame, keys: Sequence[str], name: str = "stopped_at") -> DataFrame:
    """The first stop of the same key strictly after each row, if any."""
    offers = stops.select(*keys, "t", F.col("t").alias(name))
    return asof(rows, offers, keys, "t", [name], direction="forward", exact=False).drop("hit")
