"""Order-dependent operators: numbering, tails, spells, runs, gaps and smoothing.

Windows over the tape go through `plans.split`, which cuts heavy keys. Windows
over a calendar (one row per client and day, week or month) stay plain: the
calendar bounds the rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.functions.clock import DAY
from chronotape.plans.split import Measure, following, number_rows, plan_split, previous, rolling_sums, running


def causal_order(events: DataFrame, priority: dict[str, int], rest: Sequence[str], row: str) -> DataFrame:
    """Ordinal of every event in its client: time, declared priority of the type, type, source,
    the remaining fields by name, and the source row last. Nulls go last."""
    ranks = F.create_map(*[x for name, rank in priority.items() for x in (F.lit(name), F.lit(rank))])
    rank = F.coalesce(F.element_at(ranks, F.col("type")), F.lit(len(priority)))
    ordered = events.withColumn("_rank", rank)
    split = plan_split(events, ["client"], "t")
    order = [F.col("_rank"), *[F.col(c).asc_nulls_last() for c in ["type", "source", *sorted(rest)]], F.col(row).asc()]
    return number_rows(ordered, split, order).drop("_rank")


def recent_tail(
    events: DataFrame, max_events: int, max_tokens: int, order: Sequence[str] = ("t", "id"), size: str = "n_tokens"
) -> DataFrame:
    """The longest suffix of whole events of each client within both limits.

    Counted from the newest event back, both totals only grow, so an event stays
    exactly when both totals up to it fit.
    """
    turned = events.withColumns({f"_neg{i}": -F.col(c) for i, c in enumerate(order)})
    split = plan_split(turned, ["client"], "_neg0")
    then_by = [f"_neg{i}" for i in range(1, len(order))]
    counted = running(
        turned,
        split,
        [Measure("_events", "sum", F.lit(1).cast("bigint")), Measure("_tokens", "sum", F.col(size).cast("bigint"))],
        through=True,
        then_by=then_by,
    )
    kept = counted.filter((F.col("_events") <= max_events) & (F.col("_tokens") <= max_tokens))
    return kept.select(*events.columns)


def over_limit(events: DataFrame, max_events: int, max_tokens: int, size: str = "n_tokens") -> DataFrame:
    """Clients that the keep-everything policy must refuse."""
    return (
        events.groupBy("client")
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(size).cast("bigint").alias("n_tokens"))
        .filter((F.col("n_events") > max_events) | (F.col("n_tokens") > max_tokens))
    )


def offsets(rows: DataFrame, keys: Sequence[str], at: str, length: str, name: str = "start") -> DataFrame:
    """Where each row starts when the rows of a key are laid end to end."""
    split = plan_split(rows, keys, at)
    return running(rows, split, [Measure(name, "sum", F.col(length).cast("bigint"))], then_by=[])


def stage_at(transitions: DataFrame, moment: int, keys: Sequence[str] = ("client",)) -> DataFrame:
    """The latest transition of each key at or before a moment."""
    known = transitions.filter(F.col("started_at") <= moment)
    last = F.max_by(F.struct("stage", "started_at"), F.struct("started_at", "id"))
    return known.groupBy(*keys).agg(last.alias("x")).select(
        *keys, F.col("x.stage").alias("stage"), F.col("x.started_at").alias("stage_since")
    )


def spells(transitions: DataFrame, until: int, carried: Sequence[str] = ()) -> DataFrame:
    """Each stage with its end, the stage after it, and whether the end is only the data's end."""
    rows = following(
        transitions, "started_at", ["client"], {"_next_at": "started_at", "next_stage": "stage"}, ["id"]
    )
    ended = F.coalesce(F.col("_next_at"), F.lit(until))
    return rows.select(
        "client", "id", "started_at", "stage", *carried, "next_stage",
        F.col("_next_at").isNull().alias("censored"),
        ended.alias("ended_at"),
        ((ended - F.col("started_at")) / F.lit(float(DAY))).alias("days"),
    )


def spine(bounds: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per key and whole number from first to last."""
    rest = [c for c in bounds.columns if c not in (first, last)]
    return bounds.select(*rest, F.explode(F.sequence(F.col(first), F.col(last))).alias(name))


def weekly_counts(events: DataFrame, mask: Column, day: Column) -> DataFrame:
    """Masked events per client and ISO week (numbered by the day of its Monday / 7), empty weeks included."""
    week = F.floor((day + 3) / 7).cast("bigint")
    weeks = events.groupBy("client", week.alias("week")).agg(F.count_if(mask).alias("n"))
    span = weeks.groupBy("client").agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    return spine(span, "lo", "hi", "week").join(weeks, ["client", "week"], "left").fillna(0, subset=["n"])


def trailing_flag(weeks: DataFrame, size: int, total: int, name: str, at_most: bool = False) -> DataFrame:
    """Sum over the last `size` weeks and whether it reaches (or stays under) a total; false before `size` weeks."""
    order = Window.partitionBy("client").orderBy("week").rowsBetween(-(size - 1), 0)
    summed, seen = F.sum("n").over(order), F.count(F.lit(1)).over(order)
    hit = summed <= total if at_most else summed >= total
    return weeks.withColumns({f"{name}_sum": summed, name: (seen == size) & hit})


def run_lengths(weeks: DataFrame, flag: str, name: str) -> DataFrame:
    """Length so far of the current run of true weeks and the week it began; 0 and null outside runs."""
    order = Window.partitionBy("client").orderBy("week")
    before = F.max(F.when(~F.col(flag), F.col("week"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("week").over(Window.partitionBy("client").orderBy("week").rowsBetween(Window.unboundedPreceding, 0))
    began = F.coalesce(before + 1, first)
    return weeks.withColumns(
        {
            f"{name}_length": F.when(F.col(flag), F.col("week") - began + 1).otherwise(0).cast("bigint"),
            f"{name}_start": F.when(F.col(flag), began),
        }
    )


def daily_table(events: DataFrame, day: Column, masks: dict[str, Column], keys: Sequence[str] = ("client",)) -> DataFrame:
    """Counts per client and day for every named mask; one row per active day."""
    return events.groupBy(*keys, day.alias("day")).agg(*[F.count_if(m).alias(n) for n, m in masks.items()])


def silences(daily: DataFrame, length: int, end_day: int) -> DataFrame:
    """Runs of at least `length` days without action after an action, with what came before.

    `daily` has one row per client and active day (columns action, friction,
    salary, own_out). A silence starts on the day after an action day.
    """
    days = Window.partitionBy("client").orderBy("day")

    def before(name: str, left: int, right: int) -> Column:
        # Days [start - left, start - right) where start = day + 1.
        return F.coalesce(F.sum(name).over(days.rangeBetween(1 - left, -right)), F.lit(0))

    marked = daily.select(
        "client",
        "day",
        "action",
        (before("friction", 60, 0) > 0).alias("friction"),
        ((before("salary", 120, 60) > 0) & (before("salary", 60, 0) == 0)).alias("salary_stop"),
        (before("own_out", 60, 0) > before("own_out", 120, 60)).alias("outflow_up"),
        (
            (before("action", 90, 30) > 0)
            & (before("action", 30, 0) / 30 < F.lit(0.5) * before("action", 90, 30) / 60)
        ).alias("fading"),
    ).filter("action > 0")
    after = F.lead("day").over(days)
    gaps = marked.withColumn("next_day", after)
    stop = F.coalesce(F.col("next_day"), F.lit(end_day))
    return gaps.filter(stop - F.col("day") - 1 >= length).select(
        "client",
        (F.col("day") + 1).alias("start_day"),
        (stop - F.col("day") - 1).alias("silent_days"),
        F.col("next_day").isNotNull().alias("returned"),
        "friction", "salary_stop", "outflow_up", "fading",
    )


def trips(rows: DataFrame, gap: int) -> DataFrame:
    """Number the trips of a client: a pause longer than `gap` starts the next one."""
    split = plan_split(rows, ["client"], "t")
    paused = previous(rows, split, {"_before": "t"}, ["id"])
    new = (F.col("_before").isNotNull() & (F.col("t") - F.col("_before") > gap)).cast("bigint")
    return running(
        paused, split, [Measure("trip", "sum", new)], through=True, then_by=["id"]
    ).drop("_before")


def around_event(daily: DataFrame, value: str, flag: str, span: int, first_day: int, last_day: int) -> DataFrame:
    """Sum of a daily value over +1..+span and -span..-1 days around flagged days whose frames lie inside the data."""
    days = Window.partitionBy("client").orderBy("day")
    after = F.coalesce(F.sum(value).over(days.rangeBetween(1, span)), F.lit(0))
    before = F.coalesce(F.sum(value).over(days.rangeBetween(-span, -1)), F.lit(0))
    return (
        daily.select("client", "day", flag, after.alias("after"), before.alias("before"))
        .filter(F.col(flag) > 0)
        .filter((F.col("day") - span >= first_day) & (F.col("day") + span <= last_day))
        .select("client", "day", "after", "before")
    )


def smoothed(steps: DataFrame, keys: Sequence[str], step: str, value: str, size: int, name: str) -> DataFrame:
    """Mean of the last `size` rows (fewer at the start). `step` numbers the rows of a key without holes;
    value is a whole number, so the mean does not depend on the order of summation."""
    split = plan_split(steps, keys, step)
    summed = rolling_sums(
        steps, split, {"w": size - 1}, {"_v": F.col(value), "_n": F.when(F.col(value).isNotNull(), F.lit(1))}
    )
    total = F.col("_v_w") + F.coalesce(F.col(value), F.lit(0))
    n = F.col("_n_w") + F.col(value).isNotNull().cast("int")
    return summed.select(*steps.columns, F.when(n > 0, total / n).alias(name))


def thin_blocks(steps: DataFrame, keys: Sequence[str], row: str, step: str, value: str, points: int) -> DataFrame:
    """At most `points` rows per key: fixed blocks of neighbours, their mean value and last step."""
    sizes = steps.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(points))).cast("bigint").alias("_size"))
    blocks = steps.join(sizes, list(keys)).withColumn("block", F.floor(F.col(row) / F.col("_size")).cast("bigint"))
    return blocks.groupBy(*keys, "block").agg(F.max(step).alias(step), F.avg(value).alias(value))


def thin_curve(curve: DataFrame, keys: Sequence[str], row: str, value: str, limit: int) -> DataFrame:
    """Every k-th point, and always the best (lowest, earliest) and the last one."""
    facts = curve.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(limit))).cast("bigint").alias("_stride"),
        F.max(row).alias("_last"),
        F.min(F.struct(value, row)).alias("_best"),
    )
    keep = (
        (F.pmod(F.col(row), F.greatest(F.col("_stride"), F.lit(1))) == 0)
        | (F.col(row) == F.col("_last"))
        | (F.col(row) == F.col(f"_best.{row}"))
    )
    return curve.join(facts, list(keys)).filter(keep).select(*curve.columns)


def growth(monthly: DataFrame, keys: Sequence[str], month: str, value: str, lag: int) -> DataFrame:
    """value(month + lag) / value(month) - 1 where both months exist."""
    later = monthly.select(*keys, (F.col(month) - lag).alias(month), F.col(value).alias("_later"))
    return monthly.join(later, [*keys, month]).select(
        *keys, month, (F.col("_later") / F.col(value) - 1).alias("growth")
    )


def pair_resolution(events: DataFrame, cutoff: int, edges: Sequence[float]) -> DataFrame:
    """Neighbouring events of a client by age: equal stamps, up to 1 s, up to 60 s apart,
    and distinct stamps that 8*log1p(age/8) in single precision no longer tells apart."""
    known = events.filter(F.col("t") < cutoff)
    split = plan_split(known, ["client"], "t")
    pairs = previous(known, split, {"_before": "t"}, ["id"]).filter(F.col("_before").isNotNull())
    gap = (F.col("t") - F.col("_before")) / F.lit(1e6)

    def logged(t: Column) -> Column:
        return (F.lit(8.0) * F.log1p((F.lit(cutoff) - t) / F.lit(8e6))).cast("float")

    age = (F.lit(cutoff) - F.col("t")) / F.lit(float(DAY))
    label = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        label = F.when(age <= edges[i + 1], F.lit(i)).otherwise(label)
    return (
        pairs.select(
            label.cast("int").alias("age_bin"),
            gap.alias("gap"),
            (logged(F.col("t")) == logged(F.col("_before"))).alias("same_log"),
        )
        .groupBy("age_bin")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(F.col("gap") == 0).alias("same_stamp"),
            F.count_if((F.col("gap") > 0) & (F.col("gap") <= 1)).alias("within_1s"),
            F.count_if((F.col("gap") > 0) & (F.col("gap") <= 60)).alias("within_60s"),
            F.count_if(F.col("same_log") & (F.col("gap") > 0)).alias("collapsed"),
        )
    )


def episodes(transitions: DataFrame, opening: str, closing: str, until: int) -> DataFrame:
    """From an opening value to the next closing one; an episode still open ends with the data.

    Repeated openings continue the episode: only a row whose value differs from
    the relevant row before it starts or ends one.
    """
    relevant = transitions.filter(F.col("stage").isin(opening, closing))
    split = plan_split(relevant, ["client"], "started_at")
    turned = previous(relevant, split, {"_before": "stage"}, ["id"]).filter(
        F.col("_before").isNull() | (F.col("_before") != F.col("stage"))
    )
    ends = following(turned, "started_at", ["client"], {"_end": "started_at"}, ["id"], like=split)
    return ends.filter(F.col("stage") == opening).select(
        "client", F.col("started_at").alias("opened_at"), F.coalesce(F.col("_end"), F.lit(until)).alias("closed_at")
    )
