"""Target masks: which values of a client's events a model must restore.

Every draw is a hash of what it decides about (seed, stream, client, event or
key), so it does not depend on the order or the partition of the rows. Rows are
values: client, id (event), key_id, place (number of the value in its event),
ids, target (whether the event may hold targets).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.functions.hashing import uniform
from chronotape.operators.corpus import WEIGHT_MAX, mode, total_variation
from chronotape.operators.vocabulary import MASK, UNK

# Reasons by strength, and the label that is not scored.
NONE, EVENT, KEY, VALUE = 0, 1, 2, 3
REASONS = ("none", "event", "key", "value")
IGNORE = -100


@dataclass(frozen=True)
class Masking:
    """How much to hide."""

    seed: int = 42
    value_probability: float = 0.15
    event_probability: float = 0.10
    key_probability: float = 0.10
    unknown_probability: float = 0.10
    context_probability: float = 0.5
    min_value_probability: float = 0.05
    max_value_probability: float = 0.35
    groups: tuple[tuple[int, ...], ...] = ()
    event_only_key: int | None = None


def probability(rows: DataFrame, weights: DataFrame | None, scale: float, config: Masking) -> DataFrame:
    """Adds `chance`: the base rate, or the base times the weights of key and value within bounds.

    `weights` has one row per (key_id, ids) with key_weight and value_weight. A
    value unseen in training has the largest weight; a key without weights the
    base rate.
    """
    base = config.value_probability
    if weights is None:
        return rows.withColumn("chance", F.lit(base))
    per_key = weights.groupBy("key_id").agg(F.max("key_weight").alias("_kw"))
    joined = rows.join(per_key, "key_id", "left").join(
        weights.select("key_id", "ids", F.col("value_weight").alias("_vw")), ["key_id", "ids"], "left"
    )
    raw = F.when(F.col("_kw").isNull(), F.lit(base)).otherwise(
        F.lit(base * scale) * F.col("_kw") * F.coalesce("_vw", F.lit(WEIGHT_MAX))
    )
    bounded = F.least(F.lit(config.max_value_probability), F.greatest(F.lit(config.min_value_probability), raw))
    return joined.withColumn("chance", bounded).drop("_kw", "_vw")


def draw(config: Masking, stream: str, *parts: str) -> Column:
    return uniform(str(config.seed), stream, *[F.col(p) for p in parts])


def choose(rows: DataFrame, config: Masking) -> DataFrame:
    """Adds `reason` (0 none, 1 event, 2 key, 3 value), `unknown` and `spoiled`.

    A chosen value goes to [UNK] instead of [MASK] with a small chance and is
    then no target. Values outside the targets whose key was chosen for the
    client are spoiled to [UNK] with their own chance.
    """
    target = F.col("target")
    by_event = draw(config, "event", "client", "id") < config.event_probability
    by_key = draw(config, "key", "client", "key_id") < config.key_probability
    by_value = draw(config, "value", "client", "id", "key_id", "place") < F.col("chance")
    # A client's key is drawn only when some target value of the client has it.
    keys = rows.filter("target").select("client", "key_id").distinct().filter(by_key).withColumn("_drawn", F.lit(True))
    rows = rows.join(keys, ["client", "key_id"], "left")
    key_drawn = F.col("_drawn").isNotNull()
    reason = (
        F.when(~target, F.lit(NONE)).when(by_event, F.lit(EVENT)).when(key_drawn, F.lit(KEY)).when(by_value, F.lit(VALUE)).otherwise(F.lit(NONE))
    )
    if config.event_only_key is not None:
        special = F.col("key_id") == config.event_only_key
        reason = F.when(special & (reason != EVENT), F.lit(NONE)).otherwise(reason)
        key_drawn = key_drawn & ~special
    unknown = draw(config, "unknown", "client", "id", "key_id", "place") < config.unknown_probability
    spoiled = ~target & key_drawn & (
        draw(config, "context", "client", "id", "key_id", "place") < config.context_probability
    )
    chosen = rows.withColumns({"reason": reason.cast("int"), "spoiled": spoiled}).drop("_drawn")
    chosen = chosen.withColumn("unknown", (F.col("reason") > 0) & unknown)
    return close_groups(chosen, config.groups) if config.groups else chosen


def close_groups(chosen: DataFrame, groups: Sequence[Sequence[int]]) -> DataFrame:
    """A target of a field group hides the other values of its group in the event, with the strongest reason.

    The window holds the values of one field group in one event.
    """
    group = F.lit(None).cast("int")
    for number, members in enumerate(groups):
        group = F.when(F.col("key_id").isin(*members), F.lit(number)).otherwise(group)
    source = F.col("reason").isin(KEY, VALUE) & ~F.col("unknown")
    window = Window.partitionBy("client", "id", "_group")
    strongest = F.min(F.when(source, F.col("reason"))).over(window)
    free = (F.col("reason") == NONE) & F.col("target") & F.col("_group").isNotNull() & F.col("_strongest").isNotNull()
    return (
        chosen.withColumn("_group", group)
        .withColumn("_strongest", strongest)
        .withColumn("reason", F.when(free, F.col("_strongest")).otherwise(F.col("reason")))
        .drop("_group", "_strongest")
    )


def applied(chosen: DataFrame) -> DataFrame:
    """Per value: the ids a model sees, the labels it must restore, and the reason of each token."""
    n = F.size("ids")
    hidden = (F.col("reason") > 0) & ~F.col("unknown")
    gone = F.col("unknown") | F.col("spoiled")
    return chosen.withColumns(
        {
            "input_ids": F.when(hidden, F.array_repeat(F.lit(MASK), n)).when(gone, F.array_repeat(F.lit(UNK), n)).otherwise(F.col("ids")),
            "labels": F.when(hidden, F.col("ids")).otherwise(F.array_repeat(F.lit(IGNORE), n)),
            "reasons": F.array_repeat(F.when(hidden, F.col("reason")).otherwise(F.lit(NONE)), n),
        }
    )


def masked_events(chosen: DataFrame, marker: int) -> DataFrame:
    """One row per event: input ids, labels and reasons in token order, marker first."""
    item = F.struct("key_id", "place", "input_ids", "labels", "reasons")
    lists = applied(chosen).groupBy("client", "id").agg(F.array_sort(F.collect_list(item)).alias("_v"))

    def joined(field: str, lead: int) -> Column:
        return F.concat(F.array(F.lit(lead)), F.flatten(F.transform("_v", lambda v: v[field])))

    return lists.select(
        "client",
        "id",
        joined("input_ids", marker).alias("input_ids"),
        joined("labels", IGNORE).alias("labels"),
        joined("reasons", NONE).alias("reasons"),
    )


def overlaps(spans: DataFrame) -> DataFrame:
    """Values of one event whose token spans overlap: an error of the input."""
    order = Window.partitionBy("client", "id").orderBy("start")
    end = F.lag(F.col("start") + F.col("length")).over(order)
    return spans.withColumn("_end", end).filter(F.col("start") < F.col("_end")).select("client", "id", "start")


def report(chosen: DataFrame) -> DataFrame:
    """Per key: values and targets with their shares, targets by reason, [UNK], the top value in data and
    targets, mean chance, and the distance between targets and data."""
    rows = chosen.filter("target").withColumn("_value", F.array_join("ids", ","))
    hit = (F.col("reason") > 0) & ~F.col("unknown")
    keys = rows.groupBy("key_id").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(hit).alias("targets"),
        *[F.count_if(hit & (F.col("reason") == r)).alias(f"by_{REASONS[r]}") for r in (EVENT, KEY, VALUE)],
        F.count_if("unknown").alias("unknown"),
        F.avg("chance").alias("mean_chance"),
    )
    totals = keys.agg(F.sum("n_values").alias("v"), F.sum("targets").alias("t"))
    data = rows.groupBy("key_id", "_value").agg(F.count(F.lit(1)).alias("n"))
    found = rows.filter(hit).groupBy("key_id", "_value").agg(F.count(F.lit(1)).alias("n"))
    top = mode(data, ["key_id"], "_value").select("key_id", F.col("top").alias("top_value"), F.col("share").alias("top_data_share"))
    in_targets = found.select("key_id", F.col("_value").alias("top_value"), F.col("n").alias("_top_targets"))
    distance = total_variation(found, data, ["key_id"], "_value").withColumnRenamed("tv", "value_tv")
    out = keys.join(top, "key_id").join(in_targets, ["key_id", "top_value"], "left").join(distance, "key_id", "left")
    t = F.col("targets")
    return out.select(
        "key_id",
        "n_values",
        (F.col("n_values") / totals.select("v").scalar()).alias("data_share"),
        "targets",
        (t / totals.select("t").scalar()).alias("target_share"),
        "by_event",
        "by_key",
        "by_value",
        "unknown",
        "top_value",
        "top_data_share",
        F.when(t > 0, F.coalesce("_top_targets", F.lit(0)) / t).alias("top_target_share"),
        "mean_chance",
        F.when(t > 0, F.col("value_tv")).alias("value_tv"),
    )


def visible_partners(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Targets whose event still shows a value of a key that determines theirs (pairs: key_id, partner_id)."""
    rows = chosen.filter("target")
    hit = (F.col("reason") > 0) & ~F.col("unknown")
    shown = rows.filter(F.col("reason") == NONE).select("client", "id", F.col("key_id").alias("partner_id")).distinct()
    targets = rows.filter(hit)
    with_partner = (
        targets.join(pairs, "key_id").join(shown, ["client", "id", "partner_id"]).select("client", "id", "key_id", "place").distinct()
    )
    n = with_partner.agg(F.count(F.lit(1)).alias("n")).scalar()
    return targets.agg(F.count(F.lit(1)).alias("targets")).select(
        "targets", n.alias("with_visible_partner"), (n / F.col("targets")).alias("share")
    )
