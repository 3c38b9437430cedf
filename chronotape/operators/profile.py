"""The client's profile as of a moment, rolled back from the final snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.functions.clock import DAY, full_months, full_years, local_date
from chronotape.operators.checks import require_empty

SALARIED = ("salary",)


def first_changes(changes: DataFrame, cutoff: int, fields: Sequence[str]) -> DataFrame:
    """Per (client, field) the old value of the first change at or after T."""
    later = changes.filter((F.col("t") >= cutoff) & F.col("field_name").isin(*fields))
    return later.groupBy("client", "field_name").agg(
        F.min_by("old_value", F.struct("t", "id")).alias("old_value"), F.min("t").alias("changed_at")
    )


def roll_back(snapshot: DataFrame, changes: DataFrame, cutoff: int, fields: Sequence[str]) -> DataFrame:
    """Snapshot fields as they were at T.

    A later change carries the value at T in its old value: null there means the
    field was empty at T. Without a later change the snapshot's value holds.
    """
    first = first_changes(changes, cutoff, fields)
    wide = first.groupBy("client").agg(
        *[
            F.max(F.when(F.col("field_name") == f, F.struct(F.lit(1).alias("hit"), "old_value"))).alias(f"_{f}")
            for f in fields
        ]
    )
    types = dict(snapshot.dtypes)
    joined = snapshot.join(wide, "client", "left")
    return joined.withColumns(
        {
            f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.old_value").try_cast(types[f])).otherwise(F.col(f))
            for f in fields
        }
    ).drop(*[f"_{f}" for f in fields])


def unreadable_changes(snapshot: DataFrame, changes: DataFrame, cutoff: int, fields: Sequence[str]) -> DataFrame:
    """Old values that should be taken at T but do not read as their field's type."""
    types = dict(snapshot.dtypes)
    first = first_changes(changes, cutoff, fields).filter(F.col("old_value").isNotNull())
    bad = F.lit(False)
    for f in fields:
        bad = bad | ((F.col("field_name") == f) & F.col("old_value").try_cast(types[f]).isNull())
    return first.filter(bad)


def refuse_future_cutoff(snapshot: DataFrame, cutoff: int) -> None:
    """A snapshot cannot be rolled forward."""
    require_empty(snapshot.filter(F.col("as_of") < cutoff).select("client", "as_of"), "snapshot older than T")


def milestone_moment(name: str, before: Column | int) -> Column:
    """Earliest milestone of a kind strictly before a moment."""
    known = F.filter("lifelong", lambda x: (x["type"] == name) & (x["t"] < before))
    return F.array_min(F.transform(known, lambda x: x["t"]))


def days_since_milestone(name: str, moment: Column | int) -> Column:
    moment = F.lit(moment) if isinstance(moment, int) else moment
    return (moment - milestone_moment(name, moment)) / F.lit(float(DAY))


def date_of(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int"))


def age_at(birth_day: Column, moment: Column) -> Column:
    return full_years(date_of(birth_day), local_date(moment))


def job_months(moment: Column) -> Column:
    """Whole months in the latest job recorded before the moment, for salaried income only."""
    known = F.filter("employment", lambda x: x["recorded"] < moment)
    last = F.array_max(F.transform(known, lambda x: F.struct(x["recorded"].alias("r"), x["start_day"].alias("d"))))
    months = full_months(date_of(last["d"]), local_date(moment))
    return F.when(F.col("income_type").isin(*SALARIED) & months.isNotNull(), F.greatest(F.lit(0), months))


def profile_at(
    snapshot: DataFrame, changes: DataFrame, cutoff: int, fields: Sequence[str], milestones: Sequence[str]
) -> DataFrame:
    """Rolled-back fields, age, job tenure and days since milestones at T."""
    moment = F.lit(cutoff)
    rolled = roll_back(snapshot, changes, cutoff, fields)
    return rolled.select(
        "client",
        "gender",
        *fields,
        age_at(F.col("birth_day"), moment).alias("age"),
        job_months(moment).alias("job_tenure_months"),
        *[days_since_milestone(m, cutoff).alias(f"days_since_{m}") for m in milestones],
    )


def attribute_policy(snapshot_fields: DataFrame, changed: DataFrame, derived: Sequence[str], shortcut: Sequence[str]) -> DataFrame:
    """Why each snapshot field is in or out: changed by events, derived, excluded, or constant."""
    name = F.col("field")
    return snapshot_fields.join(changed.select("field").distinct().withColumn("seen", F.lit(True)), "field", "left").select(
        "field",
        F.when(name.isin(*shortcut), "excluded_shortcut")
        .when(name.isin(*derived), "derived")
        .when(F.col("seen"), "changed_by_event")
        .otherwise("constant")
        .alias("policy"),
    )
