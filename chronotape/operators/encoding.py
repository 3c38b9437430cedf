"""Encoding: long values to ids, events and profiles to token arrays, clients to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.operators.checks import require_empty
from chronotape.operators.corpus import bucket_place
from chronotape.operators.vocabulary import EVT, PAD, UNK, USR, Vocabulary
from chronotape.operators.windows import recent_tail
from chronotape.plans.shared import written


def coded_values(values: DataFrame, vocab: Vocabulary, texts: DataFrame | None = None) -> DataFrame:
    """Adds key_id and ids to long values (key, kind, vtype, value, cond).

    Categories and numbers give one id, unknown ones [UNK]; a text gives its
    pieces and an empty text no row. Keys outside the vocabulary give no row.
    """
    # The keys are declared ones: they are sent to the tasks, and the values stay where they are.
    known = values.join(F.broadcast(vocab.keys.select("key", F.col("id").alias("key_id"))), "key")
    carried = [c for c in known.columns]
    category = known.filter("kind = 'categorical'").join(
        vocab.values.select("key", "value", F.col("id").alias("_id")), ["key", "value"], "left"
    )
    category = category.select(*carried, F.array(F.coalesce("_id", F.lit(UNK))).alias("ids"))
    numeric = known.filter("kind = 'numeric'").withColumn("number", F.col("value").try_cast("double"))
    scales = vocab.scales.withColumn("_first", F.col("first_id")).drop("first_id", "n_buckets")
    placed = bucket_place(numeric, scales)
    number = placed.select(
        *carried, F.array(F.coalesce((F.col("_first") + F.col("place")).cast("int"), F.lit(UNK))).alias("ids")
    )
    out = category.unionByName(number)
    if texts is not None:
        rows = known.filter("kind = 'text'")
        named = texts.select(F.col("normalized").alias("_text"), F.col("ids"))
        coded = rows.join(named, rows["normalized"] == named["_text"]).select(*carried, "ids")
        out = out.unionByName(coded)
    return out


def _record(pairs: Column, marker: int) -> dict[str, Column]:
    """Token arrays of one record: a marker, then the pairs with positions starting again at 0."""
    lead = F.array(F.lit(marker))
    keys = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["key_id"], F.size(p["ids"]))))
    places = F.flatten(F.transform(pairs, lambda p: F.sequence(F.lit(0), F.size(p["ids"]) - 1)))
    return {
        "key_ids": F.concat(lead, keys),
        "value_ids": F.concat(lead, F.flatten(F.transform(pairs, lambda p: p["ids"]))),
        "positions": F.concat(F.array(F.lit(0)), places),
    }


NO_PAIRS = "array<struct<key_id:int,ids:array<int>>>"


def encoded_events(events: DataFrame, coded: DataFrame) -> DataFrame:
    """One row per event with its token arrays; an event without values is its marker alone.

    An event has at most one pair per declared key, so the list is short.
    """
    pairs = coded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key_id", "ids"))).alias("_pairs"))
    joined = events.join(pairs, "id", "left").withColumn("_pairs", F.coalesce("_pairs", F.array().cast(NO_PAIRS)))
    return joined.withColumns(_record(F.col("_pairs"), EVT)).drop("_pairs").withColumn(
        "n_tokens", F.size("key_ids")
    )


def encoded_profiles(attributes: DataFrame, milestones: DataFrame, clients: DataFrame) -> DataFrame:
    """Profile tokens of every client: marker, attributes by key id, then milestones in order with their time.

    `attributes` has (client, key_id, ids), `milestones` (client, t, place, key_id, ids).
    """
    a = attributes.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("key_id", "ids"))).alias("_a"))
    m = milestones.groupBy("client").agg(
        F.array_sort(F.collect_list(F.struct("t", "place", "key_id", "ids"))).alias("_m")
    )
    rows = clients.join(a, "client", "left").join(m, "client", "left")
    rows = rows.withColumns(
        {
            "_a": F.coalesce("_a", F.array().cast(NO_PAIRS)),
            "_m": F.coalesce("_m", F.array().cast("array<struct<t:bigint,place:int,key_id:int,ids:array<int>>>")),
        }
    )
    pairs = F.concat("_a", F.transform("_m", lambda x: F.struct(x["key_id"].alias("key_id"), x["ids"].alias("ids"))))
    undated = F.transform(F.sequence(F.lit(0), F.size(F.flatten(F.transform("_a", lambda p: p["ids"])))), lambda _: F.lit(None).cast("bigint"))
    dated = F.flatten(F.transform("_m", lambda x: F.array_repeat(x["t"], F.size(x["ids"]))))
    return rows.withColumns({**_record(pairs, USR), "time": F.concat(undated, dated)}).drop("_a", "_m")


def within_limit(size: Column, limit: int | None, what: str) -> Column:
    """The size itself; a size over the limit stops the job, as nothing is ever cut inside an event or a profile."""
    if limit is None:
        return size
    message = F.concat(F.lit(f"{what} of client "), F.col("client"), F.lit(" takes "), size.cast("string"), F.lit(f" tokens; the limit is {limit}"))
    return F.when(size > limit, F.raise_error(message).cast("int")).otherwise(size)


def samples(
    events: DataFrame,
    max_events: int,
    max_tokens: int,
    eligible: Column,
    can_be_target: Column | None = None,
    *,
    clients: DataFrame | None = None,
    profiles: DataFrame | None = None,
    max_event_tokens: int | None = None,
    max_profile_tokens: int | None = None,
) -> DataFrame:
    """One row per client: the recent tail within both limits, flattened, with offsets, target mask and profile.

    `eligible` is the target period, `can_be_target` what may be a target inside it; events cut off are
    counted by the period alone. Every client of `clients` (without it, of `events`) has a row: one without
    kept events has empty arrays. `events` may carry `calendar` (numbers per event), `profiles` the token
    arrays of encoded_profiles. The tail is cut before the lists are collected, so a list never exceeds the
    limits, however long the history is.
    """
    allowed = F.lit(True) if can_be_target is None else can_be_target
    flagged = events.withColumns(
        {"_eligible": eligible, "_target": eligible & allowed, "n_tokens": within_limit(F.col("n_tokens"), max_event_tokens, "an event")}
    )
    if "calendar" not in events.columns:
        flagged = flagged.withColumn("calendar", F.array().cast("array<double>"))
    # Encoded once: the tail and the counts read what is written.
    flagged = written(flagged.select("client", "t", "id", "n_tokens", "key_ids", "value_ids", "positions", "calendar", "_target", "_eligible"), "encoded")
    kept = recent_tail(flagged, max_events, max_tokens)
    counted = flagged.groupBy("client").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_eligible").alias("_targets"))
    # The tail has at most max_events rows, so this window is bounded.
    before = Window.partitionBy("client").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    started = kept.withColumn("_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("int"))
    item = F.struct("t", "id", "key_ids", "value_ids", "positions", "calendar", "_target", "_eligible", "_start")
    lists = started.groupBy("client").agg(F.array_sort(F.collect_list(item)).alias("_e"))
    known = counted if clients is None else clients.select("client").join(counted, "client", "left")
    out = (
        known.join(lists, "client", "left")
        .withColumn("_e", F.coalesce("_e", F.array().cast(lists.schema["_e"].dataType)))
        .withColumns(
            {
                "key_ids": F.flatten(F.transform("_e", lambda e: e["key_ids"])),
                "value_ids": F.flatten(F.transform("_e", lambda e: e["value_ids"])),
                "positions": F.flatten(F.transform("_e", lambda e: e["positions"])),
                "event_starts": F.transform("_e", lambda e: e["_start"]),
                "event_lengths": F.transform("_e", lambda e: F.size(e["key_ids"])),
                "event_time": F.transform("_e", lambda e: e["t"]),
                "event_ids": F.transform("_e", lambda e: e["id"]),
                "calendar": F.flatten(F.transform("_e", lambda e: e["calendar"])),
                "target_event_mask": F.transform("_e", lambda e: e["_target"]),
            }
        )
        .withColumns(
            {
                "excluded_events": F.coalesce("_all", F.lit(0)) - F.size("_e"),
                "excluded_targets": F.coalesce("_targets", F.lit(0)) - F.size(F.filter("_e", lambda e: e["_eligible"])),
            }
        )
        .drop("_e", "_all", "_targets")
    )
    if profiles is None:
        return out
    held = profiles.select(
        "client",
        F.col("key_ids").alias("profile_key_ids"),
        F.col("value_ids").alias("profile_value_ids"),
        F.col("positions").alias("profile_positions"),
        F.col("time").alias("profile_time"),
        within_limit(F.size("key_ids"), max_profile_tokens, "the profile").alias("profile_tokens"),
    )
    joined = out.join(held, "client", "left").withColumn("profile_tokens", F.coalesce("profile_tokens", F.lit(0)))
    arrays = [c for c in held.columns if c.startswith("profile_") and c != "profile_tokens"]
    return joined.withColumns({c: F.coalesce(c, F.array().cast(held.schema[c].dataType)) for c in arrays})


def lost_targets(sample: DataFrame) -> DataFrame:
    """Clients whose context limit cut off events of the target period: an error for an evaluation group."""
    return sample.filter("excluded_targets > 0").select("client", "excluded_targets")


def require_whole_targets(sample: DataFrame) -> DataFrame:
    """The samples of an evaluation group; stops when a limit cut off events of the target period."""
    require_empty(lost_targets(sample), "clients that lost events of the target period")
    return sample


def sample_problems(sample: DataFrame, size: int) -> DataFrame:
    """Broken invariants of samples: (client, problem)."""
    n = F.size("key_ids")
    ids = F.concat("key_ids", "value_ids")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.zip_with("event_starts", "event_lengths", lambda s, l: s + l)
    step = F.transform(
        index,
        lambda i: (F.get("positions", i) == 0) | (F.get("positions", i) == F.get("positions", i - 1) + 1),
    )
    checks = {
        "length": (n != F.size("value_ids")) | (n != F.size("positions")),
        "channels": (F.size("event_starts") != F.size("event_lengths"))
        | (F.size("event_starts") != F.size("event_time"))
        | (F.size("event_starts") != F.size("target_event_mask")),
        "cover": (F.coalesce(F.get("event_starts", F.lit(0)), F.lit(0)) != 0)
        | (F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) != n)
        | (F.slice("event_starts", 2, F.size("event_starts")) != F.slice(ends, 1, F.greatest(F.size("event_starts") - 1, F.lit(0)))),
        "empty event": F.exists("event_lengths", lambda x: x < 1),
        "marker": F.exists(
            "event_starts",
            lambda s: (F.get("key_ids", s) != F.get("value_ids", s)) | (F.get("positions", s) != 0),
        ),
        "position": F.exists(step, lambda ok: ~F.coalesce(ok, F.lit(True))),
        "id range": F.exists(ids, lambda x: (x < 0) | (x >= size)),
        "padding": F.array_contains(ids, F.lit(PAD)),
        "time order": F.array_sort("event_time") != F.col("event_time"),
    }
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return sample.select("client", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("problem"))


def values_of(events: DataFrame) -> DataFrame:
    """Token arrays back to values: one row per value with its key, start and length in the event."""
    tokens = events.select(
        *[c for c in ("client", "id", "t") if c in events.columns],
        F.size("key_ids").alias("_n"),
        F.posexplode(F.arrays_zip("key_ids", "value_ids", "positions")).alias("place", "x"),
        F.col("positions").alias("_positions"),
    ).filter((F.col("place") > 0) & (F.col("x.positions") == 0))
    # The value ends where the next position 0 stands, or with the event.
    rest = F.slice("_positions", F.col("place") + 2, F.col("_n"))
    after = F.array_position(rest, 0)
    length = F.when(after > 0, after).otherwise(F.col("_n") - F.col("place")).cast("int")
    return tokens.select(
        *[c for c in ("client", "id", "t") if c in events.columns],
        F.col("x.key_ids").alias("key_id"),
        F.col("place").alias("start"),
        length.alias("length"),
    )


def event_type_of(key_ids: str, value_ids: str, positions: str, type_key: Column) -> Column:
    """The value id that stands under the event-type key; null without one."""
    zipped = F.arrays_zip(F.col(key_ids).alias("k"), F.col(value_ids).alias("v"), F.col(positions).alias("p"))
    tail = F.slice(zipped, 2, F.size(zipped))
    found = F.filter(tail, lambda x: (x["k"] == type_key) & (x["p"] == 0))
    return F.get(found, F.lit(0))["v"]


def leaks(events: DataFrame, cutoff: int) -> DataFrame:
    """Events of an input that are not strictly before T."""
    return events.filter(F.col("t") >= cutoff).select("client", "id", "t")


def counters(events: DataFrame, sample: DataFrame) -> DataFrame:
    """Totals of an encoding and of the samples made of it."""
    e = events.agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.size(F.filter("positions", lambda p: p == 0)) - 1).alias("value_count"),
        F.sum(F.size(F.filter("value_ids", lambda v: v == UNK))).alias("unknown"),
    )
    s = sample.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("excluded_events") > 0).alias("truncated"),
        F.sum(F.size("event_starts")).alias("kept_events"),
        F.sum(F.size("key_ids")).alias("kept_tokens"),
        F.sum(F.size(F.filter("target_event_mask", lambda m: m))).alias("targets"),
        F.count_if(F.exists("target_event_mask", lambda m: m)).alias("with_targets"),
        F.count_if(F.size("event_starts") == 0).alias("silent"),
        *([F.sum("profile_tokens").alias("profile_tokens"), F.count_if(F.col("profile_tokens") <= 1).alias("empty_profiles")]
          if "profile_tokens" in sample.columns else []),
    )
    # Both sides are one row: the numbers of one report line.
    return e.select("*", *[s.select(c).scalar().alias(c) for c in s.columns])

