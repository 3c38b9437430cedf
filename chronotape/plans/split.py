"""Ordered work per key that holds when one key owns a third of all rows.

A window partitioned by client puts a client into one task. So the rows of each key are counted first, once for
all operators that work on them. Keys of up to TARGET_ROWS rows go through a plain window. The rows of heavier
keys are laid out once more: range-partitioned by key, order and tie-breakers and written, so that a slice is a
range of the whole order. The window then runs per (key, slice), and the totals of the slices, accumulated over
the earlier ones, are joined back as the carry.

There are as many slices as the rows ask for, without an end. Slices are cut by the total order, so the rows of
one instant are cut as well. Where an operator compares moments only, rows are first added up per instant, the
instants are laid out, and every row takes the value of its instant.

The driver gets two numbers per plan: how many keys are heavy, and how many rows they have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.plans.shared import written

#: Rows of a slice, more or less.
TARGET_CONF = "spark.chronotape.splitRows"
TARGET_ROWS = 1_000_000
#: Heavy keys that are sent to every task; more of them are joined by a shuffle.
SENT_KEYS = 100_000

_SLICE = "_slice"


@dataclass(frozen=True)
class Split:
    """How the rows of `keys` are ordered by `at`, and which keys are heavy.

    `rows` is how many rows the heavy keys have together, 0 if there are none; `heavy` is the table of them
    (none without keys: then all rows are one group).
    """

    keys: tuple[str, ...]
    at: str
    rows: int = 0
    heavy: DataFrame | None = None
    sent: bool = True


def target_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(TARGET_CONF, str(TARGET_ROWS)))


def plan_split(df: DataFrame, keys: Sequence[str], at: str, like: Split | None = None) -> Split:
    """Count the rows of every key, to be ordered by `at` (a number, never null).

    `like` is the split of a table of which every row gives one row of a key here, at most. With the same keys
    it is taken over; with fewer keys and none heavy, none can be heavy here. So a table is counted once.
    """
    keys = tuple(keys)
    if like is not None:
        if like.keys == keys:
            return replace(like, at=at)
        if not like.rows and set(like.keys) <= set(keys):
            return Split(keys, at)
    target = target_rows(df)
    if not keys:
        rows = df.select(F.lit(1)).count()
        return Split(keys, at, rows if rows > target else 0)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target)
    many, rows = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not many:
        return Split(keys, at)
    return Split(keys, at, int(rows), written(counted.select(*keys), "heavy"), many <= SENT_KEYS)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"{prefix}{key}"])
    return condition


def _parted(df: DataFrame, split: Split) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the light keys (none without keys) and of the heavy ones, these written once."""
    if split.heavy is None:
        return None, written(df, "heavy")
    heavy = split.heavy.select(*[F.col(k).alias(f"_h_{k}") for k in split.keys])
    heavy = F.broadcast(heavy) if split.sent else heavy
    same = _same(df, heavy, split.keys, "_h_")
    return df.join(heavy, same, "left_anti"), written(df.join(heavy, same, "left_semi"), "heavy")


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null on both sides; the keys appear once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Measure:
    """One accumulated column: how is 'sum', 'max' or 'min' of value."""

    name: str
    how: str
    value: Column


_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def _framed(keys: Sequence[str], order: Sequence[Column | str], by_row: bool, through: bool):
    window = Window.partitionBy(*keys).orderBy(*order)
    last = 0 if through else -1
    return window.rowsBetween(Window.unboundedPreceding, last) if by_row else window.rangeBetween(Window.unboundedPreceding, last)


def running(
    df: DataFrame,
    split: Split,
    measures: Sequence[Measure],
    *,
    through: bool = False,
    then_by: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Accumulate measures over the earlier rows of each key.

    Without `then_by` rows are compared by `split.at` alone, so rows of one
    moment never see each other unless `through` is set, and then all do.
    With `then_by` the order is total and works row by row. `through` includes
    the current row.
    """
    if not split.rows:
        return _plain(df, split, measures, through, then_by)
    light, heavy = _parted(df, split)
    if then_by is None:
        done = _by_instant(heavy, heavy, split.at, split, measures, through)
    else:
        done = _by_slices(heavy, split, measures, through, then_by)
    return done if light is None else _plain(light, split, measures, through, then_by).unionByName(done)


def _plain(df: DataFrame, split: Split, measures: Sequence[Measure], through: bool, then_by) -> DataFrame:
    """All rows of a key in one window."""
    window = _framed(split.keys, [F.col(split.at).asc(), *(then_by or [])], then_by is not None, through)
    found = [_AGGREGATE[m.how](m.value).over(window) for m in measures]
    return df.select("*", *[(F.coalesce(v, F.lit(0)) if m.how == "sum" else v).alias(m.name) for m, v in zip(measures, found, strict=True)])


def _by_slices(df: DataFrame, split: Split, measures: Sequence[Measure], through: bool, then_by: Sequence[Column | str]) -> DataFrame:
    """Rows in ranges of the total order; each range adds what the earlier ones of its key have."""
    keys, order = list(split.keys), [F.col(split.at).asc(), *then_by]
    raw = {m.name: f"_raw_{m.name}" for m in measures}
    slices = -(-split.rows // target_rows(df))
    ranged = df.select("*", *[m.value.alias(raw[m.name]) for m in measures]).repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    laid = written(ranged.withColumn(_SLICE, F.spark_partition_id()), "layout")
    totals = laid.groupBy(*keys, _SLICE).agg(*[_AGGREGATE[m.how](raw[m.name]).alias(raw[m.name]) for m in measures])
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_ckey_{k}") for k in keys],
        F.col(_SLICE).alias("_cslice_"),
        *[_AGGREGATE[m.how](raw[m.name]).over(before).alias(f"_cval_{m.name}") for m in measures],
    )
    # One carry row per key and slice.
    joined = laid.join(carry, _same(laid, carry, keys, "_ckey_") & (laid[_SLICE] == carry["_cslice_"]))
    window = _framed([*keys, _SLICE], order, True, through)
    found = []
    for m in measures:
        local, carried = _AGGREGATE[m.how](raw[m.name]).over(window), F.col(f"_cval_{m.name}")
        if m.how == "sum":
            value = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        else:
            value = F.greatest(local, carried) if m.how == "max" else F.least(local, carried)
        found.append(value.alias(m.name))
    return joined.select(*df.columns, *found)


def _by_instant(rows: DataFrame, source: DataFrame, at: str, split: Split, measures: Sequence[Measure], through: bool) -> DataFrame:
    """`rows` with the measures of `source` before (or through) the moment split.at: `source` is added up per moment `at` first."""
    keys = list(split.keys)
    instants = source.groupBy(*keys, F.col(at).alias("_instant")).agg(*[_AGGREGATE[m.how](m.value).alias(m.name) for m in measures])
    parts = [Measure(f"_upto_{m.name}", m.how, F.col(m.name)) for m in measures]
    done = _by_slices(instants, replace(split, at="_instant"), parts, through, [])
    done = done.select(*[F.col(k).alias(f"_i_{k}") for k in keys], F.col("_instant").alias("_i_"), *[f"_upto_{m.name}" for m in measures])
    joined = rows.join(done, _same(rows, done, keys, "_i_") & (rows[split.at] == done["_i_"]))
    return joined.select(*rows.columns, *[F.col(f"_upto_{m.name}").alias(m.name) for m in measures])


def rolling_sums(
    df: DataFrame,
    split: Split,
    windows: dict[str, int],
    values: dict[str, Column],
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Sum values over [at - window, at) of the same key, for each window.

    Adds `<value>_<window>`, 0 when the frame is empty. Values are whole
    numbers or decimals, so that any grouping of the sum is exact. A value
    enters at its moment and leaves (as its negative) one window later, so a
    rolling sum is a running sum: its cost does not grow with the frame.
    """
    pairs = list(pairs) if pairs is not None else [(v, w) for v in values for w in windows]
    keys, at = list(split.keys), split.at
    sizes = sorted({windows[w] for _, w in pairs})
    names = [f"{v}_{w}" for v, w in pairs]
    measures = [Measure(n, "sum", F.col(f"_raw_{n}")) for n in names]

    def moved(rows: DataFrame, payload: list[Column]) -> DataFrame:
        """Every row at its moment, with its payload, and again where its values leave a window."""
        base = rows.select(*keys, F.col(at).alias("_at"), *payload, *[F.coalesce(v, F.lit(0)).alias(f"_raw_{n}") for n, v in values.items()])
        # What leaves is only needed where something entered.
        entered = F.lit(False)
        for n in values:
            entered = entered | (F.col(f"_raw_{n}") != 0)
        now, later = F.array(F.lit(0).cast("bigint")), F.array(*[F.lit(x).cast("bigint") for x in sizes])
        shifted = base.select("*", F.explode(F.when(entered, F.concat(now, later)).otherwise(now)).alias("_shift"))
        deltas = []
        for v, w in pairs:
            sign = F.when(F.col("_shift") == 0, 1).when(F.col("_shift") == windows[w], -1).otherwise(0)
            deltas.append((sign * F.col(f"_raw_{v}")).alias(f"_raw_{v}_{w}"))
        carried = [F.when(F.col("_shift") == 0, F.col("_row")).alias("_row")] if payload else []
        return shifted.select(*keys, *carried, (F.col("_at") + F.col("_shift")).alias("_moment"), *deltas)

    def plain(rows: DataFrame) -> DataFrame:
        packed = F.struct(*[c for c in df.columns if c not in keys]).alias("_row")
        summed = _plain(moved(rows, [packed]), replace(split, at="_moment"), measures, False, None)
        return summed.filter("_row is not null").select(
            *[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns], *names
        )

    if not split.rows:
        return plain(df)
    light, heavy = _parted(df, split)
    done = _by_instant(heavy, moved(heavy, []), "_moment", split, measures, False)
    return done if light is None else plain(light).unionByName(done)


def number_rows(df: DataFrame, split: Split, then_by: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """Number the rows of each key from 0 in a total order."""
    if not split.rows:
        order = Window.partitionBy(*split.keys).orderBy(F.col(split.at).asc(), *then_by)
        return df.withColumn(name, (F.row_number().over(order) - 1).cast("bigint"))
    return running(df, split, [Measure(name, "sum", F.lit(1).cast("bigint"))], then_by=then_by).withColumn(
        name, F.col(name).cast("bigint")
    )


def previous(
    df: DataFrame, split: Split, values: dict[str, Column | str], then_by: Sequence[str]
) -> DataFrame:
    """`lag` by one row: the values of the row before in the total order (at, then_by)."""
    return _neighbour(df, split, values, then_by, F.lag)


def following(
    df: DataFrame, split_at: str, keys: Sequence[str], values: dict[str, Column | str], then_by: Sequence[str], like: Split | None = None
) -> DataFrame:
    """`lead` by one row: the values of the row after in the total order (order columns are numbers)."""
    split = plan_split(df, keys, split_at, like)
    if not split.rows:
        return _neighbour(df, split, values, then_by, F.lead)
    turned = df.select("*", (-F.col(split_at)).alias("_neg"), *[(-F.col(c)).alias(f"_neg{i}") for i, c in enumerate(then_by)])
    reverse = [f"_neg{i}" for i in range(len(then_by))]
    return _neighbour(turned, replace(split, at="_neg"), values, reverse, F.lag).drop("_neg", *reverse)


def _neighbour(df: DataFrame, split: Split, values: dict[str, Column | str], then_by: Sequence[str], step) -> DataFrame:
    names = list(values)
    picked = [(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()]
    if not split.rows:
        order = Window.partitionBy(*split.keys).orderBy(split.at, *then_by)
        out = df.withColumn("_beside", step(F.struct(*picked)).over(order))
    else:
        packed = F.struct(F.col(split.at).alias("_at"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(then_by)], *picked)
        out = running(df, split, [Measure("_beside", "max", packed)], then_by=list(then_by))
    return out.select(*df.columns, *[F.col(f"_beside.{n}").alias(n) for n in names])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    interpolate: bool = True,
) -> DataFrame:
    """Exact quantiles per key from value counts, without holding a group in memory.

    Interpolated quantiles use position (n - 1) * p between neighbours; the
    other rule returns the first value whose share of rows reaches p.
    """
    keys = list(keys)
    counts = written(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "values"
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    below = running(
        counts, plan_split(counts, keys, value), [Measure("_below", "sum", F.col("_n"))], then_by=[]
    )
    if keys:
        joined = match(below, totals, keys, "inner")
    else:
        joined = below.withColumn("_total", totals.scalar())
    found = []
    upto = F.col("_below") + F.col("_n")

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(upto > rank, F.col(value)))

    for name, p in probabilities.items():
        if interpolate:
            place = (F.col("_total") - 1) * F.lit(p)
            low = F.floor(place)
            found.append(at_rank(low).cast("double").alias(f"_lo_{name}"))
            found.append(at_rank(F.ceil(place)).cast("double").alias(f"_hi_{name}"))
            found.append(F.max(place - low).alias(f"_w_{name}"))
        else:
            found.append(F.min(F.when(upto >= F.col("_total") * F.lit(p), F.col(value))).alias(name))
    out = joined.groupBy(*keys).agg(*found)
    if interpolate:
        out = out.select(
            *keys,
            *[
                (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
                for n in probabilities
            ],
        )
    return out
