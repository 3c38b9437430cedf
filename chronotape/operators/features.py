"""Client features strictly before T, and the labels after it.

A feature is a name and an aggregate. All features of a client come out of one
groupBy, so the tape is shuffled once as partial aggregates. Distinct counts
keep, per (client, field, value), the latest moment: a value was seen within a
window when its latest moment was.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.functions.clock import DAY, local_day
from chronotape.functions.hashing import joined, sha_number
from chronotape.operators import predicates as p
from chronotape.operators.predicates import kind, sure

ACTION_WINDOWS = (7, 30, 60, 90)
LONG_WINDOW = 365
FLOWS = ("purchase", "transfer", "cash_out", "cash_in")
WINBACK_PREFIX = "WB_"


def within(cutoff: int, days: float | None) -> Column:
    """Not older than `days` before T; rows are strictly before T already."""
    return F.lit(True) if days is None else F.col("t") >= F.lit(int(cutoff - days * DAY))


def count_where(mask: Column, cutoff: int, days: float | None = None) -> Column:
    return F.count_if(mask & within(cutoff, days))


def total_where(mask: Column, value: str, cutoff: int, days: float | None = None) -> Column:
    """Sum of the present values, 0 when there is none."""
    return F.coalesce(F.sum(F.when(mask & within(cutoff, days), F.col(value))), F.lit(0))


def days_since_last(mask: Column, cutoff: int) -> Column:
    return (F.lit(cutoff) - F.max(F.when(mask, F.col("t")))) / F.lit(float(DAY))


def days_since_first(mask: Column, cutoff: int, days: float | None = None) -> Column:
    return (F.lit(cutoff) - F.min(F.when(mask & within(cutoff, days), F.col("t")))) / F.lit(float(DAY))


def max_where(mask: Column, value: str, cutoff: int, days: float | None = None) -> Column:
    return F.max(F.when(mask & within(cutoff, days), F.col(value)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null unless the denominator is positive."""
    return F.when(whole > 0, part / whole)


def past(events: DataFrame, cutoff: int) -> DataFrame:
    return events.filter(F.col("t") < F.lit(cutoff))


def distinct_counts(
    events: DataFrame, specs: Sequence[tuple[str, Column, str, float | None]], cutoff: int
) -> DataFrame:
    """Exact distinct values per client and window: specs are (name, mask, field, days)."""
    sources: list[tuple[Column, str]] = []
    index: dict[str, int] = {}
    for name, mask, field, _ in specs:
        key = (str(mask), field)
        known = [i for i, (m, f) in enumerate(sources) if (str(m), f) == key]
        if known:
            index[name] = known[0]
        else:
            index[name] = len(sources)
            sources.append((mask, field))
    marks = F.array(
        *[
            F.when(mask & F.col(field).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(field).cast("string").alias("x")))
            for i, (mask, field) in enumerate(sources)
        ]
    )
    seen = (
        past(events, cutoff)
        .select("client", "t", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
        .groupBy("client", "m.i", "m.x")
        .agg(F.max("t").alias("t"))
    )
    return seen.groupBy("client").agg(
        *[F.count_if((F.col("i") == index[name]) & within(cutoff, days)).alias(name) for name, _, _, days in specs]
    )


def active_days(events: DataFrame, mask: Column, cutoff: int, windows: Iterable[int], gap_window: int) -> DataFrame:
    """Days with a masked event per window, and gaps between neighbouring days of the last window.

    The window function sees at most gap_window + 1 rows of a client: one per day.
    """
    today = local_day(F.lit(cutoff))
    days = past(events, cutoff).filter(mask).select("client", local_day(F.col("t")).alias("day")).distinct()
    windows = list(windows)
    recent = days.filter(F.col("day") >= today - max([gap_window, *windows]))
    inside = F.col("day") >= today - gap_window
    order = Window.partitionBy("client").orderBy("day")
    gap = F.when(inside & (F.lag("day").over(order) >= today - gap_window), F.col("day") - F.lag("day").over(order))
    return (
        recent.withColumn("gap", gap)
        .groupBy("client")
        .agg(
            *[F.count_if(F.col("day") >= today - w).alias(f"act_days_{w}") for w in windows],
            F.avg("gap").alias(f"act_gap_mean_{gap_window}"),
            F.max("gap").alias(f"act_gap_max_{gap_window}"),
        )
    )


def account_balance(events: DataFrame, cutoff: int, older_than: dict[str, float]) -> DataFrame:
    """Last known balance of every account, summed per client, as of T minus some days."""
    known = past(events, cutoff).filter(F.col("balance_after").isNotNull())
    last = known.groupBy("client", "account_id").agg(
        *[
            F.max_by(
                F.when(F.col("t") < F.lit(int(cutoff - d * DAY)), F.col("balance_after")),
                F.when(F.col("t") < F.lit(int(cutoff - d * DAY)), F.struct("t", "id")),
            ).alias(name)
            for name, d in older_than.items()
        ]
    )
    return last.groupBy("client").agg(*[F.sum(name).alias(name) for name in older_than])


def balance_without_account(events: DataFrame) -> DataFrame:
    """Rows that carry a balance but do not say whose."""
    return events.filter(F.col("balance_after").isNotNull() & F.col("account_id").isNull())


def flow_masks() -> dict[str, Column]:
    return {
        "purchase": p.is_purchase(),
        "transfer": kind("transfer_out", "p2p_out"),
        "cash_out": kind("cash_withdrawal"),
        "cash_in": kind("cash_deposit"),
    }


def flow_aggregates(cutoff: int) -> dict[str, Column]:
    found: dict[str, Column] = {}
    for name, mask in flow_masks().items():
        for days in (7, 30, 90):
            found[f"{name}_count_{days}"] = count_where(mask, cutoff, days)
        for days in (30, 90):
            found[f"{name}_sum_{days}"] = total_where(mask, "amount", cutoff, days)
        found[f"{name}_days_since_last"] = days_since_last(mask, cutoff)
    purchase = p.is_purchase()
    system = sure(F.col("channel") == "system")
    found["purchase_declined_90"] = count_where(purchase & sure(F.col("status") == "declined"), cutoff, 90)
    found["purchase_online_90"] = count_where(purchase & sure(F.col("is_online")), cutoff, 90)
    found["bill_manual_count_90"] = count_where(kind("bill_payment") & ~system, cutoff, 90)
    found["bill_auto_count_90"] = count_where(kind("bill_payment") & system, cutoff, 90)
    found["loan_pay_manual_count_90"] = count_where(kind("loan_payment") & ~system, cutoff, 90)
    found["loan_pay_auto_count_90"] = count_where(kind("loan_payment") & system, cutoff, 90)
    found["subscription_count_90"] = count_where(
        kind("purchase") & sure(F.col("reason") == "subscription"), cutoff, 90
    )
    return found


def activity_aggregates(cutoff: int) -> dict[str, Column]:
    act = F.col("action")
    found = {
        "act_days_since_last": days_since_last(act, cutoff),
        f"act_days_since_first_{LONG_WINDOW}": days_since_first(act, cutoff, LONG_WINDOW),
        f"act_count_{LONG_WINDOW}": count_where(act, cutoff, LONG_WINDOW),
    }
    for days in ACTION_WINDOWS:
        found[f"act_count_{days}"] = count_where(act, cutoff, days)
    return found


def app_aggregates(cutoff: int) -> dict[str, Column]:
    login = p.is_login()
    found = {f"app_login_count_{d}": count_where(login, cutoff, d) for d in (7, 30, 90)}
    found["app_login_failed_30"] = count_where(login & sure(F.col("status") == "failed"), cutoff, 30)
    found["app_screen_count_30"] = count_where(kind("app_screen"), cutoff, 30)
    found["app_operation_count_30"] = count_where(kind("app_operation") & ~login, cutoff, 30)
    found["banner_click_count_90"] = count_where(kind("banner_clicked"), cutoff, 90)
    found["app_days_since_last"] = days_since_last(kind("app_operation", "app_screen"), cutoff)
    return found


def money_aggregates(cutoff: int) -> dict[str, Column]:
    salary, income = kind("salary_credit"), kind(*p.INCOME_TYPES)
    incoming = kind("transfer_in", "p2p_in")
    return {
        "salary_count_90": count_where(salary, cutoff, 90),
        "salary_sum_90": total_where(salary, "amount", cutoff, 90),
        "salary_days_since_last": days_since_last(salary, cutoff),
        "pension_count_90": count_where(kind("pension_credit"), cutoff, 90),
        "income_sum_90": total_where(income, "amount", cutoff, 90),
        "transfer_in_count_90": count_where(incoming, cutoff, 90),
        "transfer_in_sum_90": total_where(incoming, "amount", cutoff, 90),
        "fee_count_90": count_where(kind("fee_charge"), cutoff, 90),
        "insufficient_funds_90": count_where(sure(F.col("decline_reason") == "insufficient_funds"), cutoff, 90),
    }


def product_aggregates(cutoff: int) -> dict[str, Column]:
    loans = sure(F.col("source") == "loans")
    premium = kind("purchase") & sure(F.col("reason") == "insurance_premium")
    rejected = kind("application_decision")
    rejected = rejected & sure(F.col("decision") == "rejected")
    return {
        f"insurance_premium_count_{LONG_WINDOW}": count_where(premium, cutoff, LONG_WINDOW),
        "application_count_90": count_where(kind("application_submitted"), cutoff, 90),
        "application_rejected_90": count_where(rejected, cutoff, 90),
        "product_opened_90": count_where(kind("product_opened", "account_opened"), cutoff, 90),
        "product_closed_90": count_where(kind("product_closed"), cutoff, 90),
        "card_blocked_90": count_where(kind("card_blocked"), cutoff, 90),
        "installment_missed_90": count_where(kind("installment_missed"), cutoff, 90),
        "delinquency_90": count_where(kind("delinquency_registered"), cutoff, 90),
        "loan_dpd_max_90": max_where(loans, "days_past_due", cutoff, 90),
    }


def bank_aggregates(cutoff: int) -> dict[str, Column]:
    sent = kind("communication_sent")
    found = {f"comm_count_{d}": count_where(sent, cutoff, d) for d in (30, 90)}
    for channel in ("push", "sms", "call", "email"):
        found[f"comm_{channel}_90"] = count_where(sent & sure(F.col("channel") == channel), cutoff, 90)
    found["comm_delivered_90"] = count_where(sent & sure(F.col("delivered")), cutoff, 90)
    found["comm_winback_90"] = count_where(sent & sure(F.col("template").startswith(WINBACK_PREFIX)), cutoff, 90)
    withdrawn = kind("profile_change") & sure(F.col("field_name") == "consent_marketing") & sure(
        F.col("new_value") == "false"
    )
    found["consent_withdrawn"] = (F.count_if(withdrawn) > 0).cast("int")
    found["support_case_count_90"] = count_where(kind("case_opened"), cutoff, 90)
    found["fraud_alert_count_90"] = count_where(kind("fraud_alert"), cutoff, 90)
    found["events_count_90"] = count_where(F.lit(True), cutoff, 90)
    found["bank_events_count_30"] = count_where(~F.col("action"), cutoff, 30)
    return found


def distinct_specs() -> list[tuple[str, Column, str, float | None]]:
    every = F.lit(True)
    in_app = kind("app_operation", "app_screen")
    found = [(f"app_sessions_{d}", in_app, "session_id", d) for d in (7, 30, 90)]
    found += [
        ("purchase_mcc_nunique_90", p.is_purchase(), "mcc", 90),
        ("purchase_merchant_nunique_90", p.is_purchase(), "merchant_name", 90),
        ("contracts_nunique_90", every, "contract_id", 90),
        ("cards_nunique_90", every, "card_id", 90),
        ("products_nunique_90", every, "product_id", 90),
        ("loan_contracts_90", sure(F.col("source") == "loans"), "contract_id", 90),
        ("deposit_contracts_90", kind("interest_credit"), "contract_id", 90),
    ]
    return found


def aggregate(events: DataFrame, cutoff: int, aggregates: dict[str, Column]) -> DataFrame:
    """One row per client with events before T and every named aggregate."""
    return past(events, cutoff).groupBy("client").agg(*[c.alias(n) for n, c in aggregates.items()])


def with_actions(events: DataFrame) -> DataFrame:
    """Add the action flag; fields a tape does not carry are added as nulls."""
    missing = {"direction", "migration_reason", "decision"} - set(events.columns)
    for name in sorted(missing):
        events = events.withColumn(name, F.lit(None).cast("string"))
    return events.withColumn("action", p.is_client_action(set(events.columns)))


def client_features(events: DataFrame, cutoff: int) -> DataFrame:
    """The event features of a client at T: 98 columns next to `client`."""
    tape = with_actions(events)
    groups = (
        activity_aggregates, app_aggregates, flow_aggregates, money_aggregates, product_aggregates, bank_aggregates,
    )
    aggregates: dict[str, Column] = {}
    for build in groups:
        aggregates.update(build(cutoff))
    main = aggregate(tape, cutoff, aggregates)
    distinct = distinct_counts(tape, distinct_specs(), cutoff)
    days = active_days(tape, F.col("action"), cutoff, ACTION_WINDOWS, 90)
    money = account_balance(tape, cutoff, {"balance_total": 0.0, "balance_total_30d_ago": 30.0})
    table = main.join(distinct, "client", "left").join(days, "client", "left").join(money, "client", "left")
    counts = [name for name, _, _, _ in distinct_specs()] + [f"act_days_{w}" for w in ACTION_WINDOWS]
    table = table.fillna(0, subset=counts)
    purchases = F.col("purchase_count_90")
    return table.withColumns(
        {
            "act_trend_30_90": share(F.col("act_count_30"), F.col("act_count_90")),
            "purchase_mean_90": share(F.col("purchase_sum_90"), purchases),
            "purchase_declined_share_90": share(F.col("purchase_declined_90"), purchases),
            "purchase_online_share_90": share(F.col("purchase_online_90"), purchases),
            "comm_delivered_share_90": share(F.col("comm_delivered_90"), F.col("comm_count_90")),
            "balance_change_30": F.col("balance_total") - F.col("balance_total_30d_ago"),
        }
    ).drop("purchase_declined_90", "purchase_online_90", "comm_delivered_90")


def churn_labels(events: DataFrame, cutoff: int, horizon_days: int = 60, active_days_before: int = 90) -> DataFrame:
    """Per client: acted before T, acted in the last 90 days, and no action in (T, T + horizon]."""
    act = F.col("action")
    t = F.col("t")
    end = cutoff + horizon_days * DAY
    return (
        with_actions(events)
        .groupBy("client")
        .agg(
            (F.count_if(act & (t < cutoff)) > 0).alias("in_population"),
            (F.count_if(act & (t < cutoff) & (t >= cutoff - active_days_before * DAY)) > 0).alias("active_90"),
            (F.count_if(act & (t > cutoff) & (t <= end)) == 0).cast("int").alias("churned"),
        )
    )


def future_labels(clients: DataFrame, future: DataFrame, cutoff: int, horizon_days: int = 60) -> DataFrame:
    """Labels from a separate continuation tape: a client absent from it did not act."""
    acting = (
        with_actions(future)
        .filter(F.col("action") & (F.col("t") > cutoff) & (F.col("t") <= cutoff + horizon_days * DAY))
        .select("client")
        .distinct()
        .withColumn("acted", F.lit(True))
    )
    return clients.join(acting, "client", "left").select(
        *clients.columns, F.col("acted").isNull().cast("int").alias("churned")
    )


def task_rows(labels: DataFrame, diverged: DataFrame) -> DataFrame:
    """The rows a model sees: in the population, active in the last 90 days, not diverged."""
    return labels.filter("in_population and active_90").join(diverged.select("client"), "client", "left_anti")


def label_distribution(rows: DataFrame, dims: Sequence[str], label: str = "y") -> DataFrame:
    """Counts by every single dimension and over all, in one pass."""
    sets = [list(d) for d in [[], *[[d] for d in dims]]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims])
    return grouped.agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(label).cast("bigint").alias("positive"),
    )


def sampled_negatives(rows: DataFrame, row: str, one_of: int, seed: str = "negatives") -> DataFrame:
    """Every positive and one of N negatives by a hash of the row, with the weight that makes up for it."""
    kept = (F.col("y") == 1) | (F.pmod(sha_number(joined(seed, F.col(row))), F.lit(one_of)) == 0)
    return rows.filter(kept).withColumn("weight", F.when(F.col("y") == 1, 1).otherwise(one_of))


def valid_window() -> Column:
    """The target window lies inside the history window and is not empty."""
    return (
        (F.col("history_start") <= F.col("target_start"))
        & (F.col("target_start") < F.col("target_end"))
        & (F.col("target_end") <= F.col("final_cutoff"))
    )
