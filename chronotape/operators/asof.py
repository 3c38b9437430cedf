"""As-of joins by key, with the rows of both sides merged in one ordered pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.plans.split import Measure, plan_split, running


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    *,
    direction: str = "backward",
    exact: bool = True,
    tie: str | None = None,
    hit: str = "hit",
) -> DataFrame:
    """Attach to every left row the nearest right row of the same key.

    `at` is a whole-number moment on both sides. Backward takes the latest
    right row at or before the left one, forward the earliest at or after;
    without `exact` equal moments do not match. Among right rows of one moment
    `tie` (a number) decides: the last one backward, the first one forward.
    `hit` tells a match with null values from no match.
    """
    keys = list(keys)
    sign = F.lit(1 if direction == "backward" else -1)
    order = sign * (F.col(tie) if tie else F.lit(0))
    found = F.struct(
        (sign * F.col(at)).alias("at"), order.cast("bigint").alias("tie"), *[F.col(v).alias(f"v_{v}") for v in values]
    )
    rest = [c for c in left.columns if c not in keys]
    probes = left.select(*keys, (sign * F.col(at)).alias("_at"), F.struct(*rest).alias("_row"))
    offers = right.select(*keys, (sign * F.col(at)).alias("_at"), found.alias("_found"))
    merged = probes.unionByName(offers, allowMissingColumns=True)
    split = plan_split(merged, keys, "_at")
    matched = running(merged, split, [Measure("_match", "max", F.col("_found"))], through=exact)
    return matched.filter(F.col("_row").isNotNull()).select(
        *keys,
        "_row.*",
        *[F.col(f"_match.v_{v}").alias(v) for v in values],
        F.col("_match").isNotNull().alias(hit),
    )


def with_fallback(hit: str, value: str, snapshot: str):
    """The value of a match, even a null one; without a match the snapshot's."""
    return F.when(F.col(hit), F.col(value)).otherwise(F.col(snapshot))
