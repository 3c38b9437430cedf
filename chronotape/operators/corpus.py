"""Corpus statistics over long values (client, id, t, type, key, kind, vtype, value)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from chronotape.plans.shared import written
from chronotape.plans.split import Measure, match, plan_split, quantiles, running


def value_counts(values: DataFrame) -> DataFrame:
    """Occurrences and distinct clients of every (key, value kind, value)."""
    per_client = values.groupBy("key", "vtype", "value", "client").agg(F.count(F.lit(1)).alias("n"))
    return per_client.groupBy("key", "vtype", "value").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("clients")
    )


def key_counts(values: DataFrame) -> DataFrame:
    """Occurrences, clients and event types of every key."""
    per_client = values.groupBy("key", "client").agg(F.count(F.lit(1)).alias("n"))
    types = values.select("key", "type").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("types"))
    return (
        per_client.groupBy("key")
        .agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("clients"))
        .join(types, "key")
    )


def is_number(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def numeric_summary(numbers: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Per key (and condition): counts by sign, invalid values, range, exact distinct values and clients.

    `numbers` has a double column `number`. Distinct values and clients are
    counted by grouping twice, so no group is held in memory.
    """
    keys = list(keys)
    n = F.col("number")
    good = is_number(n)
    main = numbers.groupBy(*keys).agg(
        F.count_if(good).alias("n"),
        F.count_if(good & (n == 0)).alias("n_zero"),
        F.count_if(good & (n < 0)).alias("n_negative"),
        F.count_if(~good).alias("n_invalid"),
        F.min(F.when(good, n)).alias("minimum"),
        F.max(F.when(good, n)).alias("maximum"),
    )
    distinct = numbers.filter(good).select(*keys, "number").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_values")
    )
    clients = numbers.select(*keys, "client").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("clients"))

    joined = match(match(main, distinct, keys), clients, keys)
    return joined.fillna(0, subset=["distinct_values", "clients"])


def text_corpus(texts: DataFrame) -> DataFrame:
    """Frequency, clients and bytes of every normalised text; texts that are empty count apart (null text)."""
    per_client = texts.groupBy("key", "normalized", "client").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("value")).alias("bytes")
    )
    return per_client.groupBy("key", "normalized").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("clients"), F.max("bytes").alias("max_bytes")
    )


def declared_missing(values: DataFrame, events: DataFrame, declared: DataFrame) -> DataFrame:
    """How many events of a type lack a key declared for it."""
    totals = events.groupBy("type").agg(F.count(F.lit(1)).alias("events"))
    present = values.select("type", "key", "id").distinct().groupBy("type", "key").agg(F.count(F.lit(1)).alias("present"))
    return (
        declared.join(totals, "type")
        .join(present, ["type", "key"], "left")
        .select("type", "key", (F.col("events") - F.coalesce("present", F.lit(0))).alias("missing"))
        .filter("missing > 0")
    )


HASH_SLOTS = 4096


def bottom_k(rows: DataFrame, key: str, draw: Column, tie: str, k: int) -> DataFrame:
    """The k rows of each key with the smallest draw: a sample that no read order changes.

    Rows are counted per key and slot of the draw; only slots that can hold one
    of the k smallest are kept, so the final numbering sees about k rows of a key.
    """
    drawn = rows.withColumn("_u", draw).withColumn("_slot", F.floor(F.col("_u") * HASH_SLOTS).cast("bigint"))
    slots = drawn.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        slots.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        .filter(F.col("_before") < k)
        .groupBy(key)
        .agg(F.max("_slot").alias("_last"))
    )
    kept = drawn.join(last, key).filter(F.col("_slot") <= F.col("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_u", tie))
    return kept.withColumn("_place", place).filter(F.col("_place") <= k).select(*rows.columns)


def quantile_edges(numbers: DataFrame, keys: Sequence[str], bins: int, value: str = "number") -> DataFrame:
    """Inner boundaries of about equal groups: observed values, distinct, above the minimum."""
    found = quantiles(numbers, keys, value, _probabilities([bins]), interpolate=False)
    return found.select(*keys, _edges(bins).alias("edges"))


def _probabilities(bins: Sequence[int]) -> dict[str, float]:
    inner = {f"q{b}_{i}": i / b for b in sorted(set(bins)) for i in range(1, b)}
    return {"least": 0.0, **inner}


def _edges(bins: int) -> Column:
    points = F.array_sort(F.array_distinct(F.array(*[F.col(f"q{bins}_{i}") for i in range(1, bins)])))
    return F.filter(points, lambda e: e > F.col("least"))


@dataclass(frozen=True)
class Scale:
    """How the numbers of a key are cut into buckets."""

    key: str
    method: str                              # fixed, quantile, unfitted
    bins: int = 0
    boundaries: tuple[float, ...] = ()
    fallback: tuple[float, ...] = ()
    zero_separate: bool = False
    negative_invalid: bool = False
    negative_bins: int = 0


def fit_scales(
    numbers: DataFrame, scales: Sequence[Scale], min_values: int = 50, min_clients: int = 5
) -> DataFrame:
    """Boundaries of every (key, condition): edges, whether zero is apart, and where they came from.

    Quantiles need enough values and clients, else the fallback, else nothing.
    Negative values with a scale of their own are a second part of the key, so
    the boundaries of all keys come out of one pass.
    """
    n, key = F.col("number"), F.col("key")
    unusable, minus = F.lit(False), F.lit(False)
    for s in scales:
        mine = key == s.key
        if s.zero_separate:
            unusable = unusable | (mine & (n == 0))
        if s.negative_invalid:
            unusable = unusable | (mine & (n < 0))
        if s.negative_bins:
            minus = minus | (mine & (n < 0))
    valid = numbers.filter(is_number(n)).select("key", "cond", "client", "number", (~unusable).alias("usable"), minus.alias("minus"))
    per_client = valid.groupBy("key", "cond", "client").agg(
        F.count_if("usable").alias("usable"),
        F.count_if(F.col("usable") & F.col("minus")).alias("below"),
    )
    facts = per_client.groupBy("key", "cond").agg(
        F.sum("usable").alias("usable"), F.sum("below").alias("below"), F.count(F.lit(1)).alias("clients")
    )
    fitted = [s for s in scales if s.method == "quantile"]
    if fitted:
        bins = [s.bins for s in fitted] + [s.negative_bins for s in fitted if s.negative_bins]
        chosen = valid.filter(F.col("usable") & key.isin(*[s.key for s in fitted]))
        found = quantiles(chosen, ["key", "cond", "minus"], "number", _probabilities(bins), interpolate=False)
        sides = found.groupBy("key", "cond").agg(
            *[F.max(F.when(~F.col("minus"), _edges(s.bins))).alias(f"_main_{i}") for i, s in enumerate(fitted)],
            *[
                F.max(F.when(F.col("minus"), _edges(s.negative_bins))).alias(f"_minus_{i}")
                for i, s in enumerate(fitted)
                if s.negative_bins
            ],
        )
        facts = match(facts, sides, ["key", "cond"])

    none = F.array().cast("array<double>")

    def constant(xs: Sequence[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in xs]) if xs else none

    edges, origin, zero = none, F.lit("none"), F.lit(False)
    for s in scales:
        mine = key == s.key
        zero = F.when(mine, F.lit(s.zero_separate)).otherwise(zero)
        if s.method == "fixed":
            edges = F.when(mine, constant(s.boundaries)).otherwise(edges)
            origin = F.when(mine, F.lit("config")).otherwise(origin)
        elif s.method == "quantile":
            i = fitted.index(s)
            learned = F.coalesce(F.col(f"_main_{i}"), none)
            if s.negative_bins:
                both = (F.col("below") > 0) & (F.col("usable") > F.col("below"))
                inner = F.when(F.col("below") >= min_values, F.coalesce(F.col(f"_minus_{i}"), none)).otherwise(none)
                with_zero = F.concat(learned, inner, F.array(F.lit(0.0)))
                learned = F.array_sort(F.array_distinct(F.when(both, with_zero).otherwise(learned)))
            enough = (F.col("usable") >= min_values) & (F.col("clients") >= min_clients) & (F.size(learned) > 0)
            edges = F.when(mine, F.when(enough, learned).otherwise(constant(s.fallback))).otherwise(edges)
            source = F.when(enough, "train").when(F.lit(bool(s.fallback)), "fallback").otherwise("none")
            origin = F.when(mine, source).otherwise(origin)
    known = facts.filter(key.isin(*[s.key for s in scales]))
    return known.select("key", "cond", edges.alias("edges"), origin.alias("origin"), zero.alias("zero"))


def bucket_table(scales: DataFrame) -> DataFrame:
    """One row per bucket: [lo, hi), open at both ends of the scale; a separate zero comes first."""
    ordinary = scales.filter("origin <> 'none'").select(
        "key",
        "cond",
        F.posexplode(F.concat(F.array(F.lit(None).cast("double")), F.col("edges"))).alias("place", "lo"),
        "edges",
        "zero",
    ).select(
        "key", "cond", (F.col("place") + F.col("zero").cast("int")).alias("place"), "lo",
        F.get(F.col("edges"), F.col("place")).alias("hi"),
        F.lit(False).alias("is_zero"),
    )
    zero = scales.filter("zero and origin <> 'none'").select(
        "key", "cond", F.lit(0).alias("place"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(True).alias("is_zero")
    )
    return zero.unionByName(ordinary)


def bucket_place(numbers: DataFrame, scales: DataFrame) -> DataFrame:
    """Place of every number on its scale; null without a scale for its key and condition.

    The edges of a scale are one short array, so this is an equi-join and a
    count of edges, not a range join.
    """
    n = F.col("number")
    joined = match(numbers, scales, ["key", "cond"])
    ordinary = F.size(F.filter("edges", lambda e: e <= n)) + F.col("zero").cast("int")
    place = F.when(F.col("origin").isNull() | (F.col("origin") == "none"), F.lit(None)).when(
        F.col("zero") & (n == 0), F.lit(0)
    ).otherwise(ordinary)
    return joined.withColumn("place", place.cast("int")).drop("edges", "zero", "origin")


def occupancy(numbers: DataFrame, scales: DataFrame) -> DataFrame:
    """How many numbers fall into each bucket, empty buckets included."""
    placed = bucket_place(numbers, scales).filter("place is not null")
    counts = placed.groupBy("key", "cond", "place").agg(F.count(F.lit(1)).alias("n"))
    return match(bucket_table(scales), counts, ["key", "cond", "place"]).select(
        "key", "cond", "place", F.coalesce("n", F.lit(0)).alias("n")
    )


# Fixed values of the informativeness weights.
SMOOTHING = 1.0
WEIGHT_MIN = 0.25
WEIGHT_MAX = 3.0


def key_entropy(counts: DataFrame, keys: Sequence[str] = ("key",), n: str = "occurrences") -> DataFrame:
    """Entropy in nats per key, and the same over the log of the number of values (0 for one value)."""
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"), F.count(F.lit(1)).alias("distinct_values"))
    p = F.col(n) / F.col("_total")
    joined = counts.join(totals, keys)
    found = joined.groupBy(*keys, "distinct_values", F.col("_total").alias("total")).agg(
        (-F.sum(p * F.ln(p))).alias("entropy")
    )
    spread = F.when(F.col("distinct_values") < 2, F.lit(0.0)).otherwise(
        F.col("entropy") / F.ln(F.col("distinct_values").cast("double"))
    )
    return found.withColumn("key_weight", spread)


def value_weights(counts: DataFrame, n: str = "occurrences") -> DataFrame:
    """Weight of every value, the surprise of the value against the entropy of its key, within bounds."""
    entropies = key_entropy(counts, n=n)
    surprise = -F.ln(F.col(n) / F.col("total"))
    raw = (surprise + SMOOTHING) / (F.col("entropy") + SMOOTHING)
    return counts.join(entropies, "key").withColumn(
        "value_weight", F.least(F.lit(WEIGHT_MAX), F.greatest(F.lit(WEIGHT_MIN), raw))
    )


def weight_scale(weights: DataFrame, n: str = "occurrences") -> DataFrame:
    """The factor that keeps the mean rate of masking: occurrences over weighted occurrences."""
    weighted = F.sum(F.col(n) * F.col("key_weight") * F.col("value_weight"))
    total = F.sum(n)
    return weights.agg(F.when(weighted > 0, total / weighted).otherwise(F.lit(1.0)).alias("scale"))


def total_variation(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, n: str = "n"
) -> DataFrame:
    """Half the sum of differences of two distributions, per key."""
    keys = list(keys)
    value_columns = [*keys, value]
    both = left.select(*value_columns, F.col(n).alias("_a")).join(
        right.select(*value_columns, F.col(n).alias("_b")), value_columns, "full_outer"
    ).fillna(0, subset=["_a", "_b"])
    totals = both.groupBy(*keys).agg(F.sum("_a").alias("_at"), F.sum("_b").alias("_bt"))
    return (
        both.join(totals, keys)
        .groupBy(*keys)
        .agg((F.lit(0.5) * F.sum(F.abs(F.col("_a") / F.col("_at") - F.col("_b") / F.col("_bt")))).alias("tv"))
    )


EVENTS_PER_VALUE = 20


def paired(one: DataFrame, value: str | None = None) -> DataFrame:
    """Pairs of keys a < b of one event (id, key, and with `value` their values av and bv), from a list per event.

    An event has at most its declared keys.
    """
    item = F.struct("key", value) if value else F.struct("key")
    listed = one.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("keys"))
    first = listed.select("keys", F.posexplode("keys").alias("place", "x"))
    rest = F.slice("keys", F.col("place") + 2, F.size("keys"))
    pairs = first.select("x", F.explode(rest).alias("y"))
    more = [F.col(f"x.{value}").alias("av"), F.col(f"y.{value}").alias("bv")] if value else []
    return pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), *more)


def dependent_pairs(values: DataFrame, events_per_value: int = EVENTS_PER_VALUE) -> DataFrame:
    """H(B|A) / H(B) for keys of one event, where A has enough events per value and B varies.

    The keys of an event, which has one row per key, are paired once; the counts are then read both ways.
    """
    one = values.groupBy("id", "key").agg(F.max("value").alias("value"))
    joint = written(paired(one, "value").groupBy("a", "b", "av", "bv").agg(F.count(F.lit(1)).alias("n")), "joint")
    joint = joint.unionByName(joint.toDF("b", "a", "bv", "av", "n"))

    def spread(rows: DataFrame, name: str) -> DataFrame:
        total = rows.groupBy("a", "b").agg(F.sum("n").alias("_t"))
        p = F.col("n") / F.col("_t")
        return (
            rows.join(total, ["a", "b"])
            .groupBy("a", "b")
            .agg((-F.sum(p * F.ln(p))).alias(f"h_{name}"), F.count(F.lit(1)).alias(f"n_{name}"), F.max("_t").alias(f"t_{name}"))
        )

    by_a = joint.groupBy("a", "b", "av").agg(F.sum("n").alias("n"))
    by_b = joint.groupBy("a", "b", "bv").agg(F.sum("n").alias("n"))
    joined = spread(joint, "ab").join(spread(by_a, "a"), ["a", "b"]).join(spread(by_b, "b"), ["a", "b"])
    enough = (F.col("n_b") >= 2) & (F.col("t_ab") >= events_per_value * F.col("n_a"))
    ratio = F.greatest(F.lit(0.0), F.col("h_ab") - F.col("h_a")) / F.col("h_b")
    return joined.filter(enough).select("b", "a", F.col("t_ab").alias("events"), ratio.alias("ratio"))


def mode(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Most frequent value per key (ties by value) and its share."""
    keys = list(keys)
    best = F.min_by(value, F.struct(-F.col(n), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("top"), (F.max(n) / F.sum(n)).alias("share"))


def coincident_pairs(
    events: DataFrame, by: Sequence[str] = ("client", "t"), shown: Sequence[str] = ()
) -> DataFrame:
    """Ordered pairs of events that agree in `by`, counted by their types and the `shown` part of `by`.

    Pairs follow from the number of events per type and are never listed.
    """
    by = list(by)
    n = events.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))
    b = n.select(*by, F.col("type").alias("other"), F.col("n").alias("m"))
    pairs = F.when(F.col("type") == F.col("other"), F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("m"))
    return (
        n.join(b, by)
        .withColumn("pairs", pairs)
        .filter("pairs > 0")
        .groupBy(*shown, "type", "other")
        .agg(F.sum("pairs").alias("pairs"))
    )


def average_ranks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank of every number among all rows, ties sharing their mean rank: `<column>_rank`."""
    for c in columns:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        below = running(counts, plan_split(counts, [], c), [Measure("_below", "sum", F.col("_n"))], then_by=[])
        ranks = below.select(c, (F.col("_below") + (F.col("_n") + 1) / 2).alias(f"{c}_rank"))
        rows = rows.join(ranks, c)
    return rows


def bucket_precision(numbers: DataFrame, scales: DataFrame, key: str) -> DataFrame:
    """Rank correlation of exact sums with sums of bucket midpoints (the inner edge for open buckets)."""
    edges, place = F.col("edges"), F.size(F.filter("edges", lambda e: e <= F.col("number")))
    low, high = F.get(edges, place - 1), F.get(edges, place)
    middle = F.when(low.isNull(), high).when(high.isNull(), low).otherwise((low + high) / 2)
    joined = match(numbers, scales.select("key", "cond", "edges"), ["key", "cond"])
    # Ranking reads the sums several times: they are written once.
    sums = written(joined.groupBy(key).agg(F.sum("number").alias("exact"), F.sum(middle).alias("approx")), "sums")
    ranked = average_ranks(sums, ["exact", "approx"])
    return ranked.agg(
        F.count(F.lit(1)).alias("n"), F.corr("exact_rank", "approx_rank").alias("rank_correlation")
    )


def coincident_milestones(milestones: DataFrame, events: DataFrame) -> DataFrame:
    """Dated milestones that share their instant with an event, by kind and event type."""
    return (
        milestones.join(events, ["client", "t"])
        .groupBy("kind", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unknown_rates(train: DataFrame, values: DataFrame) -> DataFrame:
    """Share of values of each key and group that the training group never showed."""
    seen = train.select("key", "value").distinct().withColumn("_seen", F.lit(True))
    joined = values.join(seen, ["key", "value"], "left")
    n = F.count(F.lit(1))
    unseen = F.count_if(F.col("_seen").isNull())
    return joined.groupBy("key", "grp").agg(n.alias("n"), unseen.alias("unseen"), (unseen / n).alias("rate"))


