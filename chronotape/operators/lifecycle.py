"""Lifecycle stages of app clients, one decision per local day.

Everything a day needs (held products, silence, weekly runs, months without a
visit) is a column computed by Spark. What is left is the chain of stages: a
short fold over a client's days. A client has one row per day of the window,
however many events it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.functions.clock import DAY, end_of_day, local_day, month_number
from chronotape.operators import predicates as p
from chronotape.operators.features import with_actions
from chronotape.operators.predicates import kind
from chronotape.operators.profile import milestone_moment
from chronotape.operators.windows import spine
from chronotape.plans.split import plan_split, previous

# Event types that change which contracts a client holds, and two product families.
OPENING = ("product_opened", "product_migrated", "account_opened")
SIGHTING = ("card_activated", "card_reissued", "product_renewed", "contract_terms_changed", "product_repriced")
CLOSING = ("product_closed",)
SERVICE, DEBIT = "service", "debit_card"


@dataclass(frozen=True)
class Rules:
    """Days, weeks and visit counts of the stage rules."""

    new_days: int = 7
    activated_days: int = 14
    churn_days: int = 60
    high_weeks: int = 4
    high_visits: int = 16
    high_run: int = 4
    low_weeks: int = 2
    low_visits: int = 4
    low_run: int = 2
    core_products: int = 2


def registrations(snapshot: DataFrame, milestone: str = "app_registered") -> DataFrame:
    """The moment a client registered in the app: the earliest such milestone."""
    return snapshot.select("client", milestone_moment(milestone, F.lit(2**62)).alias("registered")).filter(
        "registered is not null"
    )


def ownership_changes(events: DataFrame, families: DataFrame) -> DataFrame:
    """Events that change a client's contracts: the product held after and before each.

    Openings and sightings of a known, non-service product set it; a closing clears it.
    """
    changing = events.filter(kind(*OPENING, *SIGHTING, *CLOSING) & F.col("contract_id").isNotNull())
    named = changing.join(families.select("product_id", "family", "premium"), "product_id", "left")
    opens = kind(*OPENING, *SIGHTING)
    counted = named.filter(~opens | (F.col("family").isNotNull() & (F.col("family") != SERVICE)))
    held = F.when(opens, F.struct("product_id", "family", "premium"))
    states = counted.select("client", "contract_id", "t", "id", held.alias("held"))
    split = plan_split(states, ["client", "contract_id"], "t")
    return previous(states, split, {"before": "held"}, ["id"])


def held_at(events: DataFrame, families: DataFrame, moment: int) -> DataFrame:
    """Contracts each client holds at a moment, by the last change of each."""
    changes = ownership_changes(events.filter(F.col("t") < moment), families)
    last = changes.groupBy("client", "contract_id").agg(F.max_by("held", F.struct("t", "id")).alias("held"))
    return last.filter("held is not null").select("client", "contract_id", "held.product_id", "held.family")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def daily_facts(
    tape: DataFrame, registered: DataFrame, families: DataFrame, until: int, rules: Rules = Rules()
) -> DataFrame:
    """One row per registered client and day from registration to the end, with everything the stages need."""
    events = with_actions(tape)
    known = registered.filter(F.col("registered") < until).select(
        "client", "registered", local_day(F.col("registered")).alias("first_day")
    )
    last_day = local_day(F.lit(until)) - 1
    day = local_day(F.col("t"))
    after = F.col("t") >= F.col("registered")

    marked = events.withColumns({"visit": p.is_visit(), "target": p.is_target_action(set(events.columns))})
    own = marked.join(known, "client").filter(after & (F.col("action") | F.col("visit") | F.col("target")))
    acts = own.groupBy("client", day.alias("day")).agg(
        F.max(F.when(F.col("action"), F.col("t"))).alias("action_t"),
        F.max(F.when(F.col("visit"), F.col("t"))).alias("visit_t"),
        F.count_if("visit").alias("visits"),
        F.min(F.when(F.col("target"), F.col("t"))).alias("target_t"),
    )
    changes = ownership_changes(events, families).join(known, "client")
    held, before = F.col("held"), F.col("before")
    deltas = changes.groupBy("client", F.when(after, day).otherwise(F.col("first_day") - 1).alias("day")).agg(
        F.sum(_flag(held.isNotNull()) - _flag(before.isNotNull())).alias("d_held"),
        F.sum(_flag(held["family"] == DEBIT) - _flag(before["family"] == DEBIT)).alias("d_debit"),
        F.sum(_flag(held["premium"]) - _flag(before["premium"])).alias("d_premium"),
        F.max(_flag(held.isNull() & before["premium"] & after)).alias("premium_closed"),
    )
    days = spine(known.withColumns({"lo": F.col("first_day") - 1, "hi": last_day}), "lo", "hi", "day")
    # Days, acts and changes are at most a few rows per client and day: they meet in one exchange
    # by client, which every window below and the walk itself reuse.
    stacked = days.unionByName(acts, allowMissingColumns=True).unionByName(deltas, allowMissingColumns=True)
    sums = ("visits", "d_held", "d_debit", "d_premium", "premium_closed")
    # The number of partitions is named, so that small facts still spread over the walkers.
    parts = int(tape.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = stacked.repartition(parts, "client").groupBy("client", "day").agg(
        F.max("registered").alias("registered"),
        F.max("first_day").alias("first_day"),
        *[F.max(c).alias(c) for c in ("action_t", "visit_t")],
        F.min("target_t").alias("target_t"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    ).filter("registered is not null")

    order = Window.partitionBy("client").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    midnight = end_of_day(F.col("day"))
    first_week = F.floor((F.col("first_day") + 3) / 7).cast("bigint")
    own_day = F.col("day") >= F.col("first_day")
    sunday = own_day & (F.pmod(F.col("day") + 3, F.lit(7)) == 6)
    facts = facts.withColumns({"month": month_number(midnight - 1), "sunday": sunday, "first_week": first_week})
    facts = facts.withColumns(
        {
            "last_action": F.greatest("registered", F.max("action_t").over(so_far)),
            "last_visit": F.coalesce(F.max("visit_t").over(so_far), F.lit(-1)),
            "activated_t": F.min("target_t").over(so_far),
            "held": F.sum("d_held").over(so_far),
            "debit": F.sum("d_debit").over(so_far) > 0,
            "premium": F.sum("d_premium").over(so_far) > 0,
            "visit_month": F.max(F.when(F.col("visits") > 0, F.col("month"))).over(so_far),
            "weeks": F.count_if("sunday").over(so_far),
            "high_sum": F.sum("visits").over(order.rowsBetween(1 - 7 * rules.high_weeks, 0)),
            "low_sum": F.sum("visits").over(order.rowsBetween(1 - 7 * rules.low_weeks, 0)),
        }
    )
    # Closed weeks are numbered by their Sundays: a run is as long as the weeks since the last week outside it.
    high = (F.col("weeks") >= rules.high_weeks) & (F.col("high_sum") >= rules.high_visits)
    low = (F.col("weeks") >= rules.low_weeks) & (F.col("low_sum") <= rules.low_visits)
    facts = facts.withColumns(
        {
            "low": low,
            "not_high": F.coalesce(F.max(F.when(F.col("sunday") & ~high, F.col("weeks"))).over(so_far), F.lit(0)),
            "not_low": F.coalesce(F.max(F.when(F.col("sunday") & ~low, F.col("weeks"))).over(so_far), F.lit(0)),
        }
    )
    facts = facts.withColumn("high_length", F.col("weeks") - F.col("not_high"))
    begun = F.max(F.when(F.col("sunday") & (F.col("high_length") == rules.high_run), F.col("not_high"))).over(so_far)
    facts = facts.withColumn("high_begun", begun)
    low_length = F.col("weeks") - F.col("not_low")
    declined = F.col("sunday") & (low_length == rules.low_run) & (F.col("not_low") > F.col("high_begun"))
    core = (F.col("high_length") >= rules.high_run) & (F.col("held") >= rules.core_products) & F.col("debit")
    return facts.filter(own_day).select(
        "client", "day", midnight.alias("moment"), "month", "registered", "last_action", "last_visit", "activated_t",
        month_number(F.col("activated_t")).alias("activated_month"),
        (F.col("visits") > 0).alias("visit_day"),
        ((month_number(midnight) != F.col("month")) & (F.coalesce("visit_month", F.lit(-1)) < F.col("month"))).alias("month_empty"),
        "premium", "premium_closed",
        F.coalesce(declined, F.lit(False)).alias("declined"),
        (F.col("sunday") & ~F.col("low")).alias("calm"),
        (F.col("first_week") + F.col("not_high")).alias("high_start"),
        core.alias("core"),
    )


LADDER = ("new", "activated", "growing", "core", "loyal")
#: What is carried from one day of a client to the next.
STATE = (
    "struct<stage:string,reason:string,anchor:bigint,grew:boolean,risk_since:bigint,months:array<bigint>,"
    "found:array<struct<started_at:bigint,stage:string,previous_stage:string,reason:string>>>"
)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _decision(stage: Column | str, reason: str, anchor: Column) -> Column:
    stage = F.lit(stage) if isinstance(stage, str) else stage
    return F.struct(stage.alias("stage"), F.lit(reason).alias("reason"), anchor.cast("bigint").alias("anchor"))


def _rebuilt(day: Column, state: Column, anchor: Column, since: Column, reason: str) -> Column:
    """The active stage that the facts since a moment support."""
    month = month_number(since)
    week = F.floor((local_day(since) + 3) / 7)
    top = F.when(day["premium"], "loyal").otherwise("core")
    return (
        F.when(~day["active"], _decision("new", reason, anchor))
        .when(~state["grew"] | (day["last_visit"] < since), _decision("activated", reason, F.greatest(anchor, month)))
        .when(day["core"] & (day["high_start"] >= week), _decision(top, reason, anchor))
        .otherwise(_decision("growing", reason, anchor))
    )


def _cured(day: Column, state: Column) -> Column:
    reason, since = state["reason"], state["risk_since"]
    return (
        F.when(reason == "new_no_target_action_7d", day["active"])
        .when(reason == "activated_no_action_14d", day["last_action"] >= since)
        .when(reason == "growing_not_in_mau", day["last_visit"] >= since)
        .when(reason == "core_wau_decline", day["calm"])
        .otherwise(day["premium"])
    )


def _risk(day: Column, stage: Column, rules: Rules) -> Column:
    """Why an active client is at risk today, null if it is not."""
    age = day["moment"] - day["registered"]
    early = day["activated_t"] < day["registered"] + rules.activated_days * DAY
    idle = (age >= rules.activated_days * DAY) & early & (day["last_action"] <= day["activated_t"])
    return (
        F.when((stage == "new") & ~day["active"] & (age >= rules.new_days * DAY), "new_no_target_action_7d")
        .when((stage == "activated") & idle, "activated_no_action_14d")
        .when((stage == "loyal") & day["premium_closed"] & ~day["premium"], "loyal_premium_closed")
        .when(stage.isin("core", "loyal") & day["declined"], "core_wau_decline")
        .when((stage == "growing") & day["month_empty"], "growing_not_in_mau")
    )


def _promoted(day: Column, stage: Column, anchor: Column, months: Column) -> Column:
    """As far up the ladder as the facts of the day lead."""
    gates = (day["active"], F.coalesce(F.array_contains(months, anchor + 1), F.lit(False)), day["core"], day["premium"])
    for low, high, gate in zip(LADDER, LADDER[1:], gates, strict=False):
        stage = F.when((stage == low) & gate, high).otherwise(stage)
    return stage


def _next_day(state: Column, day: Column, rules: Rules) -> Column:
    """The state after one more day."""
    anchor = F.when(day["active"] & state["anchor"].isNull(), day["activated_month"]).otherwise(state["anchor"]).cast("bigint")
    months = F.when(day["visit_day"], F.array_union(state["months"], F.array(day["month"].cast("bigint")))).otherwise(state["months"])

    def decide(now: Column) -> Column:
        stage, anchor = state["stage"], now["anchor"]
        stay = F.struct(stage.alias("stage"), state["reason"].alias("reason"), anchor.alias("anchor"))
        quiet = day["moment"] - day["last_action"] >= rules.churn_days * DAY
        why = _risk(day, stage, rules)
        at_risk = F.struct(F.lit("at_risk").alias("stage"), why.alias("reason"), anchor.alias("anchor"))
        choice = (
            F.when(quiet & (stage == "churn"), stay)
            .when(quiet, _decision("churn", "no_action_60d", anchor))
            .when(stage == "churn", _rebuilt(day, state, anchor, day["last_action"], "reactivated"))
            .when((stage == "at_risk") & _cured(day, state), _rebuilt(day, state, anchor, state["risk_since"], "recovered"))
            .when(stage == "at_risk", stay)
            .when(why.isNotNull(), at_risk)
            .otherwise(_decision(_promoted(day, stage, anchor, now["months"]), "promoted", anchor))
        )
        return _let(choice, lambda after: moved(after, now["months"]))

    def moved(after: Column, months: Column) -> Column:
        changed = after["stage"] != state["stage"]
        row = F.struct(
            day["moment"].alias("started_at"), after["stage"].alias("stage"), state["stage"].alias("previous_stage"), after["reason"].alias("reason")
        )
        return F.struct(
            after["stage"].alias("stage"),
            F.when(changed, after["reason"]).otherwise(state["reason"]).alias("reason"),
            after["anchor"].alias("anchor"),
            (state["grew"] | (after["stage"] == "growing")).alias("grew"),
            F.when(changed & (after["stage"] == "at_risk"), day["moment"]).otherwise(state["risk_since"]).alias("risk_since"),
            months.alias("months"),
            F.when(changed, F.concat(state["found"], F.array(row))).otherwise(state["found"]).alias("found"),
        ).cast(STATE)

    return _let(F.struct(anchor.alias("anchor"), months.alias("months")), decide)


def transitions(
    tape: DataFrame, registered: DataFrame, families: DataFrame, until: int, rules: Rules = Rules()
) -> DataFrame:
    """Stage transitions of every registered client: one row each, the first at registration.

    The days of a client, as many as the calendar has, are folded in order; the state of a day is the stage
    with its reason, what the stage remembers, and the transitions so far.
    """
    facts = daily_facts(tape, registered, families, until, rules)
    day = F.struct(
        "day", "moment", "month", "registered", "last_action", "last_visit", "activated_t", "activated_month", "visit_day", "month_empty",
        "premium", (F.col("premium_closed") > 0).alias("premium_closed"), "declined", F.coalesce("calm", F.lit(False)).alias("calm"), "high_start",
        F.coalesce("core", F.lit(False)).alias("core"), F.coalesce(F.col("activated_t") < F.col("moment"), F.lit(False)).alias("active"),
    )
    start = F.struct(
        F.lit("new"), F.lit("registered"), F.lit(None).cast("bigint"), F.lit(False), F.lit(0).cast("bigint"),
        F.array().cast("array<bigint>"), F.array().cast("array<struct<started_at:bigint,stage:string,previous_stage:string,reason:string>>"),
    ).cast(STATE)
    days = facts.groupBy("client").agg(F.array_sort(F.collect_list(day)).alias("days"))
    walked = days.select("client", F.aggregate("days", start, lambda state, d: _next_day(state, d, rules)).alias("end"))
    begun = registered.filter(F.col("registered") < until).select(
        "client",
        F.col("registered").alias("started_at"),
        F.lit("new").alias("stage"),
        F.lit(None).cast("string").alias("previous_stage"),
        F.lit("registered").alias("reason"),
    )
    return begun.unionByName(walked.select("client", F.explode("end.found").alias("x")).select("client", "x.*"))


def outcomes(spells: DataFrame, risk: str, lost: str) -> DataFrame:
    """What became of each risk spell, by its reason and the stage before it."""
    outcome = F.when(F.col("censored"), "open").when(F.col("next_stage") == lost, "churn").otherwise("recovered")
    return (
        spells.filter(F.col("stage") == risk)
        .groupBy("reason", "previous_stage")
        .agg(*[F.count_if(outcome == o).alias(o) for o in ("recovered", "churn", "open")])
    )


def stage_shares(by_month: DataFrame) -> DataFrame:
    """Share of each stage per month start."""
    counts = by_month.groupBy("month", "stage").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("month").agg(F.sum("n").alias("total"))
    return counts.join(totals, "month").select("month", "stage", "n", (F.col("n") / F.col("total")).alias("share"))


def stage_at_months(spells: DataFrame, months: DataFrame) -> DataFrame:
    """The stage of every client at each month start: the spell that covers it.

    `months` (month, moment) has one row per month and is joined by the months
    a spell touches, so every spell meets its own months only.
    """
    touched = spells.withColumn(
        "_m",
        F.explode(F.sequence(month_number(F.col("started_at")), month_number(F.col("ended_at")))),
    )
    return touched.join(months, touched["_m"] == months["month"]).filter(
        (F.col("started_at") <= F.col("moment")) & (F.col("moment") < F.col("ended_at"))
    ).select("client", "month", "stage")
