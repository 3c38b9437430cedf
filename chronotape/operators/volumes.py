"""Calendar cubes and volume cards: one row per client and day, then months and weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.operators.windows import spine
from chronotape.plans.split import quantiles


def day_cube(daily: DataFrame, clients: DataFrame, first_day: int, last_day: int, measures: Sequence[str]) -> DataFrame:
    """Every client on every day of the window, days without events as zeros."""
    grid = spine(
        clients.select("client").distinct().withColumns({"lo": F.lit(first_day), "hi": F.lit(last_day)}), "lo", "hi", "day"
    )
    return grid.join(daily, ["client", "day"], "left").fillna(0, subset=list(measures))


def month_of_day(day: Column) -> Column:
    date = F.date_from_unix_date(day.cast("int"))
    return F.year(date) * 12 + F.month(date) - 1


def monthly(cube: DataFrame, measures: Sequence[str]) -> DataFrame:
    return cube.groupBy("client", month_of_day(F.col("day")).cast("bigint").alias("month")).agg(
        *[F.sum(m).alias(m) for m in measures]
    )


def volume_card(months: DataFrame, events: str, actions: str) -> DataFrame:
    """Events per client-month (mean and percentiles), empty months, months with events but no action."""
    points = {f"p{q}": q / 100 for q in (10, 25, 50, 75, 90, 95, 99)}
    spread = quantiles(months, [], events, points)
    facts = months.agg(
        F.avg(events).alias("mean"),
        F.avg((F.col(events) == 0).cast("int")).alias("zero_month_share"),
        F.avg(((F.col(actions) == 0) & (F.col(events) > 0)).cast("int")).alias("no_action_month_share"),
    )
    return facts.select("*", *[spread.select(c).scalar().alias(c) for c in spread.columns])


def silence_after(cube: DataFrame, moments: Sequence[int], before: int, after: int, action: str = "action") -> DataFrame:
    """Share of clients active in the `before` days that do nothing in the `after` days, averaged over moments.

    Moments are day numbers, one per month of the window. Each day of the cube
    is added to the moments whose frames hold it, as sums of one aggregate.
    """
    day, n = F.col("day"), F.col(action)
    sums = []
    for i, m in enumerate(moments):
        sums.append(F.sum(F.when((day >= m - before) & (day < m), n)).alias(f"b{i}"))
        sums.append(F.sum(F.when((day >= m) & (day < m + after), n)).alias(f"a{i}"))
    per = cube.groupBy("client").agg(*sums)
    shares = [
        F.count_if((F.col(f"b{i}") > 0) & (F.col(f"a{i}") == 0)) / F.count_if(F.col(f"b{i}") > 0)
        for i in range(len(moments))
    ]
    one = per.agg(*[s.alias(f"s{i}") for i, s in enumerate(shares)])
    total = sum((F.col(f"s{i}") for i in range(1, len(moments))), F.col("s0"))
    return one.select((total / len(moments)).alias("share"))


def weekly(cube: DataFrame, first_day: int, weeks: int, measure: str) -> DataFrame:
    """Sums of whole weeks counted from the first day."""
    week = F.floor((F.col("day") - first_day) / 7).cast("bigint")
    return cube.groupBy("client", week.alias("week")).agg(F.sum(measure).alias("n")).filter(F.col("week") < weeks)


def autocorrelation(weeks: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Correlation of log1p weekly counts with those `lag` weeks later, over all clients and weeks.

    One row per client and week: the windows are bounded by the calendar.
    """
    order = Window.partitionBy("client").orderBy("week")
    value = F.log1p(F.col("n").cast("double"))
    rows = weeks.withColumn("x", value).select("*", *[F.lag("x", lag).over(order).alias(f"lag{lag}") for lag in lags])
    return rows.agg(*[F.corr("x", f"lag{lag}").alias(f"lag{lag}") for lag in lags])


def type_profile(events: DataFrame, types: Sequence[str], cutoff: int, windows: Sequence[int], day: int, cap: float = 365.0) -> DataFrame:
    """log1p counts per type and window, and log1p of the capped days since the type was last seen."""
    past = events.filter(F.col("t") < cutoff)
    aggregates = []
    for name in types:
        mine = F.col("type") == name
        for w in windows:
            n = F.count_if(mine & (F.col("t") >= cutoff - w * day))
            aggregates.append(F.log1p(n.cast("double")).alias(f"{name}_{w}"))
        age = (F.lit(cutoff) - F.max(F.when(mine, F.col("t")))) / F.lit(float(day))
        aggregates.append(F.log1p(F.least(F.lit(cap), F.coalesce(age, F.lit(cap)))).alias(f"{name}_recency"))
    return past.groupBy("client").agg(*aggregates)
