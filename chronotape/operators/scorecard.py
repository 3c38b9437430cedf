"""Data-quality scorecard: rows of key, value, target, ok."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.operators.joins import counts_between
from chronotape.plans.split import quantiles


def metric(frame: DataFrame, key: str, target: str, ok: Callable[[Column], Column] | None = None) -> DataFrame:
    """One scorecard row out of a one-row frame with a column `value`."""
    value = F.col("value").cast("double")
    verdict = F.lit(None).cast("boolean") if ok is None else ok(value)
    return frame.select(F.lit(key).alias("key"), value.alias("value"), F.lit(target).alias("target"), verdict.alias("ok"))


def card(metrics: Sequence[DataFrame]) -> DataFrame:
    out = metrics[0]
    for one in metrics[1:]:
        out = out.unionByName(one)
    return out


def passed(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("ok").alias("passed"), F.count("ok").alias("judged"), F.count(F.lit(1)).alias("metrics"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before.select("key", F.col("value").alias("before")), "key", "left").select(
        "key", "before", "value", "target", "ok"
    )


def share(rows: DataFrame, condition: Column) -> DataFrame:
    """Share of rows that meet a condition; null counts as not."""
    return rows.agg((F.count_if(F.coalesce(condition, F.lit(False))) / F.count(F.lit(1))).alias("value"))


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("value"))


def one_provider_share(payments: DataFrame, provider: str, least: int) -> DataFrame:
    """Among clients with at least `least` payments, the share that always paid one provider."""
    per = payments.groupBy("client", provider).agg(F.count(F.lit(1)).alias("n")).groupBy("client").agg(
        F.sum("n").alias("n"), F.count(provider).alias("providers")
    )
    return share(per.filter(F.col("n") >= least), F.col("providers") == 1)


def prices_per_month(payments: DataFrame, service: str, month: Column, price: str, least: int) -> DataFrame:
    """Median over busy services of the most prices one service had in a month."""
    busy = payments.groupBy(service).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    prices = payments.select(service, month.alias("month"), price).distinct().groupBy(service, "month").agg(
        F.count(price).alias("n")
    )
    most = prices.join(busy.select(service), service, "left_semi").groupBy(service).agg(F.max("n").alias("most"))
    return quantiles(most, [], "most", {"value": 0.5})


def silent_debts(loans: DataFrame, closed: DataFrame, before: int) -> DataFrame:
    """Contracts whose last event is old, still owes something, and was never closed."""
    last = loans.groupBy("contract_id").agg(
        F.max("t").alias("last_t"), F.max_by("outstanding", F.struct("t", "id")).alias("outstanding")
    )
    quiet = last.filter((F.col("last_t") < before) & (F.col("outstanding") > 0))
    return quiet.join(closed.select("contract_id").distinct(), "contract_id", "left_anti")


def by_day_ratio(rows: DataFrame, day: Column, chosen: Column) -> DataFrame:
    """Mean rows per chosen day over mean rows per other day (`chosen` is about the date column `date`)."""
    days = rows.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    picked = F.avg(F.when(chosen, F.col("n")))
    rest = F.avg(F.when(~chosen, F.col("n")))
    return days.agg((picked / rest).alias("value"))


def date_peak(rows: DataFrame, day: Column, month: int, day_of_month: int, apart: int = 7) -> DataFrame:
    """Rows of one date over the mean of the days of its month that are at least `apart` days away."""
    days = rows.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    inside = F.month("date") == month
    on = inside & (F.dayofmonth("date") == day_of_month)
    away = inside & (F.abs(F.dayofmonth("date") - day_of_month) >= apart)
    return days.agg((F.avg(F.when(on, F.col("n"))) / F.avg(F.when(away, F.col("n")))).alias("value"))


def segment_lift(rows: DataFrame, segment: Column, category: Column) -> DataFrame:
    """Share of a category inside a segment over its share outside."""
    inside = F.count_if(segment & category) / F.count_if(segment)
    outside = F.count_if(~segment & category) / F.count_if(~segment)
    return rows.agg((inside / outside).alias("value"))


def any_use_share(rows: DataFrame, members: Column, category: Column) -> DataFrame:
    """Share of a segment's clients with at least one row of a category."""
    per = rows.filter(members).groupBy("client").agg(F.count_if(category).alias("n"))
    return share(per, F.col("n") > 0)


def monthly_variation(rows: DataFrame, month: Column, value: str) -> DataFrame:
    """Sample deviation of monthly medians over their mean."""
    medians = quantiles(rows.select(month.alias("month"), value), ["month"], value, {"median": 0.5})
    return medians.agg((F.stddev_samp("median") / F.avg("median")).alias("value"))


def rate_ratio(rows: DataFrame, outcome: Column, high: Column, low: Column) -> DataFrame:
    """Rate of an outcome in one state over its rate in another."""
    rate = lambda state: F.count_if(state & outcome) / F.count_if(state)
    return rows.agg((rate(high) / rate(low)).alias("value"))


def episode_shares(episodes: DataFrame, events: DataFrame, income: Column, spending: Column, leaving: Column, day: int) -> DataFrame:
    """Shares of episodes with income but no spending inside, and with a leaving event near their start.

    `episodes` has (row, client, start, stop); near means 30 days before to one day after.
    """
    inside = counts_between(episodes, events, ["client"], {"income": income, "spending": spending}, "row")
    near = episodes.select(
        "row", "client", (F.col("start") - 30 * day).alias("start"), (F.col("start") + day).alias("stop")
    )
    left = counts_between(near, events, ["client"], {"leaving": leaving}, "row").select("row", "leaving")
    both = inside.join(left, "row")
    n = F.count(F.lit(1))
    return both.agg(
        n.alias("episodes"),
        (F.count_if((F.col("income") > 0) & (F.col("spending") == 0)) / n).alias("income_without_spending"),
        (F.count_if(F.col("leaving") > 0) / n).alias("left_near_start"),
    )
