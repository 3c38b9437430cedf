"""Client features at T (A1-A14, H6), labels and population (P8-P14), and their SQL."""

from pyspark.sql import functions as F

from chronotape.operators import features as fx
from chronotape.operators import predicates as p
from chronotape.operators.predicates import kind
from queries.registry import query
from queries.tables import ALL_MILESTONES, CUTOFF, DAY, LOCAL, SNAPSHOT, START, snapshot, tape, with_tape

T = CUTOFF

# --- SQL texts shared by the checks -------------------------------------------------

ACTION_SQL = """coalesce(
 type in ('app_screen','app_operation','p2p_out','cash_withdrawal','early_repayment','application_submitted','banner_clicked','case_opened')
 or (type='transfer_out' and not (coalesce(reason,'')='transfer' and coalesce(counterparty,'')='Own account'))
 or (type='transfer_in' and coalesce(reason,'')='transfer' and coalesce(counterparty,'')='Own account')
 or (type='purchase' and coalesce(reason,'')='purchase')
 or (type='cash_deposit' and coalesce(reason,'') not in ('payment_topup','card_statement'))
 or (type='bill_payment' and coalesce(channel,'system')<>'system')
 or (type='card_blocked' and coalesce(reason,'') in ('client_freeze','lost_or_stolen'))
 or (type='product_closed' and coalesce(reason,'')='early_closure')
 or (type='profile_change' and coalesce(change_source,'')='client'), false)"""
VISIT_SQL = "(type='app_operation' and coalesce(operation,'') in ('login','biometry_login') and coalesce(status,'')='success')"
LOGIN_SQL = "(type='app_operation' and coalesce(operation,'') in ('login','biometry_login'))"
TARGET_SQL = f"({ACTION_SQL} or (type='product_opened' and coalesce(reason,'')='application_approved'))"
PURCHASE_SQL = "(type='purchase' and coalesce(reason,'')='purchase')"
OPERATION_SQL = f"({PURCHASE_SQL} or type='transfer_out')"
ACTS = f"acts as (select *, {ACTION_SQL} as action from tape)"
PAST = f"past as (select * from acts where t < {T})"


def _w(days):
    return "true" if days is None else f"t >= {T - days * DAY}"


def _count(mask, days=None):
    return f"count(*) filter (where ({mask}) and {_w(days)})"


def _sum(mask, value, days=None):
    return f"coalesce(sum({value}) filter (where ({mask}) and {_w(days)}), 0)::bigint"


def _last(mask):
    return f"({T} - max(t) filter (where {mask})) / {float(DAY)!r}"


def _distinct(mask, value, days):
    return f"count(distinct {value}) filter (where ({mask}) and {_w(days)})"


FLOW_SQL = {
    "purchase": PURCHASE_SQL,
    "transfer": "type in ('transfer_out','p2p_out')",
    "cash_out": "type='cash_withdrawal'",
    "cash_in": "type='cash_deposit'",
}


def _activity_sql():
    parts = [f"{_last('action')} as act_days_since_last",
             f"({T} - min(t) filter (where action and {_w(365)})) / {float(DAY)!r} as act_days_since_first_365"]
    parts += [f"{_count('action', d)} as act_count_{d}" for d in (365, 7, 30, 60, 90)]
    return parts


def _app_sql():
    parts = [f"{_count(LOGIN_SQL, d)} as app_login_count_{d}" for d in (7, 30, 90)]
    failed = LOGIN_SQL + " and coalesce(status,'')='failed'"
    parts.append(f"{_count(failed, 30)} as app_login_failed_30")
    in_app = "type in ('app_operation','app_screen')"
    parts += [f"{_distinct(in_app, 'session_id', d)} as app_sessions_{d}" for d in (7, 30, 90)]
    screen = "type='app_screen'"
    other = f"type='app_operation' and not {LOGIN_SQL}"
    click = "type='banner_clicked'"
    parts.append(f"{_count(screen, 30)} as app_screen_count_30")
    parts.append(f"{_count(other, 30)} as app_operation_count_30")
    parts.append(f"{_count(click, 90)} as banner_click_count_90")
    parts.append(f"{_last(in_app)} as app_days_since_last")
    return parts


def _flows_sql():
    parts = []
    for name, mask in FLOW_SQL.items():
        parts += [f"{_count(mask, d)} as {name}_count_{d}" for d in (7, 30, 90)]
        parts += [f"{_sum(mask, 'amount', d)} as {name}_sum_{d}" for d in (30, 90)]
        parts.append(f"{_last(mask)} as {name}_days_since_last")
    n = f"nullif({_count(PURCHASE_SQL, 90)}, 0)"
    declined = PURCHASE_SQL + " and coalesce(status,'')='declined'"
    online = PURCHASE_SQL + " and coalesce(is_online,false)"
    parts.append(f"{_sum(PURCHASE_SQL, 'amount', 90)} / {n} as purchase_mean_90")
    parts.append(f"{_count(declined, 90)} / {n} as purchase_declined_share_90")
    parts.append(f"{_count(online, 90)} / {n} as purchase_online_share_90")
    parts.append(f"{_distinct(PURCHASE_SQL, 'mcc', 90)} as purchase_mcc_nunique_90")
    parts.append(f"{_distinct(PURCHASE_SQL, 'merchant_name', 90)} as purchase_merchant_nunique_90")
    system = "coalesce(channel,'')='system'"
    for name, t in (("bill", "bill_payment"), ("loan_pay", "loan_payment")):
        manual, auto = f"type='{t}' and not {system}", f"type='{t}' and {system}"
        parts.append(f"{_count(manual, 90)} as {name}_manual_count_90")
        parts.append(f"{_count(auto, 90)} as {name}_auto_count_90")
    subscription = "type='purchase' and coalesce(reason,'')='subscription'"
    parts.append(f"{_count(subscription, 90)} as subscription_count_90")
    return parts


def _money_sql():
    salary, incoming = "type='salary_credit'", "type in ('transfer_in','p2p_in')"
    income = "type in ('salary_credit','pension_credit','other_income_credit')"
    pension, fee = "type='pension_credit'", "type='fee_charge'"
    short = "coalesce(decline_reason,'')='insufficient_funds'"
    return [
        f"{_count(salary, 90)} as salary_count_90",
        f"{_sum(salary, 'amount', 90)} as salary_sum_90",
        f"{_last(salary)} as salary_days_since_last",
        f"{_count(pension, 90)} as pension_count_90",
        f"{_sum(income, 'amount', 90)} as income_sum_90",
        f"{_count(incoming, 90)} as transfer_in_count_90",
        f"{_sum(incoming, 'amount', 90)} as transfer_in_sum_90",
        f"{_count(fee, 90)} as fee_count_90",
        f"{_count(short, 90)} as insufficient_funds_90",
    ]


def _products_sql():
    loans = "source='loans'"
    parts = [
        f"{_distinct('true', 'contract_id', 90)} as contracts_nunique_90",
        f"{_distinct('true', 'card_id', 90)} as cards_nunique_90",
        f"{_distinct('true', 'product_id', 90)} as products_nunique_90",
        f"{_distinct(loans, 'contract_id', 90)} as loan_contracts_90",
        "count(distinct contract_id) filter (where type='interest_credit') as deposit_contracts_90",
    ]
    premium = "type='purchase' and coalesce(reason,'')='insurance_premium'"
    parts.append(f"{_count(premium, 365)} as insurance_premium_count_365")
    for name, mask in (
        ("application_count_90", "type='application_submitted'"),
        ("application_rejected_90", "type='application_decision'"),
        ("product_opened_90", "type in ('product_opened','account_opened')"),
        ("product_closed_90", "type='product_closed'"),
        ("card_blocked_90", "type='card_blocked'"),
        ("installment_missed_90", "type='installment_missed'"),
        ("delinquency_90", "type='delinquency_registered'"),
    ):
        parts.append(f"{_count(mask, 90)} as {name}")
    parts.append(f"max(days_past_due) filter (where source='loans' and {_w(90)}) as loan_dpd_max_90")
    return parts


def _bank_sql():
    sent = "type='communication_sent'"
    parts = [f"{_count(sent, d)} as comm_count_{d}" for d in (30, 90)]
    for c in ("push", "sms", "call", "email"):
        mask = f"{sent} and channel='{c}'"
        parts.append(f"{_count(mask, 90)} as comm_{c}_90")
    delivered, winback = f"{sent} and coalesce(delivered,false)", f"{sent} and template like 'WB@_%' escape '@'"
    case, alert = "type='case_opened'", "type='fraud_alert'"
    parts.append(f"{_count(delivered, 90)} / nullif({_count(sent, 90)}, 0) as comm_delivered_share_90")
    parts.append(f"{_count(winback, 90)} as comm_winback_90")
    parts.append(
        "(count(*) filter (where type='profile_change' and field_name='consent_marketing' and new_value='false') > 0)::int as consent_withdrawn"
    )
    parts.append(f"{_count(case, 90)} as support_case_count_90")
    parts.append(f"{_count(alert, 90)} as fraud_alert_count_90")
    parts.append(f"{_count('true', 90)} as events_count_90")
    parts.append(f"{_count('not action', 30)} as bank_events_count_30")
    return parts


def _grouped(parts):
    return with_tape("select client, " + ",\n ".join(parts) + " from past group by client", ACTS, PAST)


TODAY = (T + LOCAL) // DAY
DAYS_CTE = f"""days as (select distinct client, (t + {LOCAL}) // {DAY} as day from past where action),
recent as (select * from days where day >= {TODAY - 90}),
gaps as (select client, day - lag(day) over (partition by client order by day) as gap, day from recent),
active as (select client, count(*) filter (where day >= {TODAY - 7}) as act_days_7,
 count(*) filter (where day >= {TODAY - 30}) as act_days_30, count(*) filter (where day >= {TODAY - 60}) as act_days_60,
 count(*) as act_days_90, avg(gap) as act_gap_mean_90, max(gap) as act_gap_max_90 from gaps group by client)"""
BALANCE_CTE = f"""balances as (select client, account_id,
 arg_max(balance_after, (t, id)) as now,
 arg_max(balance_after, (t, id)) filter (where t < {T - 30 * DAY}) as earlier
 from past where balance_after is not null group by client, account_id),
money as (select client, sum(now)::bigint as balance_total, sum(earlier)::bigint as balance_total_30d_ago from balances group by client)"""


def acts(spark, sf):
    return fx.with_actions(tape(spark, sf))


# --- single operators ---------------------------------------------------------------


@query(
    "A1_count_window",
    with_tape(f"select client, {_count('action', 30)} as n_30, {_count('action')} as n_all from past group by client", ACTS, PAST),
)
def a1(spark, sf):
    act = F.col("action")
    return fx.aggregate(acts(spark, sf), T, {"n_30": fx.count_where(act, T, 30), "n_all": fx.count_where(act, T)})


@query(
    "A2_sum_window",
    with_tape(f"select client, {_sum(PURCHASE_SQL, 'amount', 30)} as s_30, {_sum(PURCHASE_SQL, 'amount')} as s_all from past group by client", ACTS, PAST),
)
def a2(spark, sf):
    mask = p.is_purchase()
    return fx.aggregate(
        acts(spark, sf), T, {"s_30": fx.total_where(mask, "amount", T, 30), "s_all": fx.total_where(mask, "amount", T)}
    )


@query(
    "A3_recency",
    with_tape(
        f"select client, {_last(FLOW_SQL['cash_in'])} as last_days, ({T} - min(t) filter (where type='cash_deposit')) / {float(DAY)!r} as first_days from past group by client",
        ACTS, PAST,
    ),
)
def a3(spark, sf):
    mask = kind("cash_deposit")
    return fx.aggregate(
        acts(spark, sf), T, {"last_days": fx.days_since_last(mask, T), "first_days": fx.days_since_first(mask, T)}
    )


@query(
    "A4_max_window",
    with_tape(f"select client, max(days_past_due) filter (where source='loans' and {_w(90)}) as dpd from past group by client", ACTS, PAST),
)
def a4(spark, sf):
    return fx.aggregate(acts(spark, sf), T, {"dpd": fx.max_where(F.col("source") == "loans", "days_past_due", T, 90)})


@query(
    "A5_distinct_window",
    with_tape(
        f"""select client, {_distinct(PURCHASE_SQL, 'mcc', 30)} as mcc_30, {_distinct(PURCHASE_SQL, 'mcc', 90)} as mcc_90
 from past where {PURCHASE_SQL} group by client""",
        ACTS, PAST,
    ),
)
def a5(spark, sf):
    mask = p.is_purchase()
    return fx.distinct_counts(acts(spark, sf), [("mcc_30", mask, "mcc", 30), ("mcc_90", mask, "mcc", 90)], T)


@query("A6_account_balance", with_tape("select * from money", ACTS, PAST, BALANCE_CTE))
def a6(spark, sf):
    return fx.account_balance(acts(spark, sf), T, {"balance_total": 0.0, "balance_total_30d_ago": 30.0})


@query(
    "A7_active_days",
    with_tape("select client, act_days_7, act_days_30, act_days_60, act_days_90 from active", ACTS, PAST, DAYS_CTE),
)
def a7(spark, sf):
    return fx.active_days(acts(spark, sf), F.col("action"), T, fx.ACTION_WINDOWS, 90).drop(
        "act_gap_mean_90", "act_gap_max_90"
    )


@query("A8_day_gaps", with_tape("select client, act_gap_mean_90, act_gap_max_90 from active", ACTS, PAST, DAYS_CTE))
def a8(spark, sf):
    return fx.active_days(acts(spark, sf), F.col("action"), T, fx.ACTION_WINDOWS, 90).select(
        "client", "act_gap_mean_90", "act_gap_max_90"
    )


@query(
    "A9_safe_share",
    with_tape(f"select client, {_count('action', 30)} / nullif({_count('action', 90)}, 0) as trend from past group by client", ACTS, PAST),
)
def a9(spark, sf):
    act = F.col("action")
    return fx.aggregate(acts(spark, sf), T, {"trend": fx.share(fx.count_where(act, T, 30), fx.count_where(act, T, 90))})


@query("A10_flow_family", _grouped([x for x in _flows_sql() if "nunique" not in x and "_share_" not in x and "_mean_" not in x]))
def a10(spark, sf):
    found = fx.flow_aggregates(T)
    return fx.aggregate(acts(spark, sf), T, {n: c for n, c in found.items() if n not in ("purchase_declined_90", "purchase_online_90")})


@query("A11_money_bank_families", _grouped(_money_sql() + [x for x in _bank_sql() if "_share_" not in x]))
def a11(spark, sf):
    found = {**fx.money_aggregates(T), **fx.bank_aggregates(T)}
    found.pop("comm_delivered_90")
    return fx.aggregate(acts(spark, sf), T, found)


LABELS_CTE = f"""labelled as (select client,
 count(*) filter (where action and t < {T}) > 0 as in_population,
 count(*) filter (where action and t < {T} and t >= {T - 90 * DAY}) > 0 as active_90,
 (count(*) filter (where action and t > {T} and t <= {T + 60 * DAY}) = 0)::int as churned
 from acts group by client)"""


@query("A12_churn_label", with_tape("select * from labelled", ACTS, LABELS_CTE))
def a12(spark, sf):
    return fx.churn_labels(tape(spark, sf), T)


SHORT = 5
FUTURE_SQL = f"""select c.client, (a.client is null)::int as churned
 from (select distinct client from tape where t < {T}) c
 left join (select distinct client from acts where action and t > {T} and t <= {T + SHORT * DAY}) a using (client)"""


@query("A13_label_from_future_tape", with_tape(FUTURE_SQL, ACTS))
def a13(spark, sf):
    whole = tape(spark, sf)
    clients = whole.filter(F.col("t") < T).select("client").distinct()
    return fx.future_labels(clients, whole.filter(F.col("t") >= T), T, SHORT)


@query(
    "A14_label_distribution",
    with_tape(
        f"""select type, source, grouping(type, source)::bigint as level, count(*) as n_rows, sum(y)::bigint as positive
 from (select type, source, (coalesce(status,'')='declined')::int as y from tape)
 group by grouping sets ((), (type), (source))"""
    ),
)
def a14(spark, sf):
    rows = tape(spark, sf).select(
        "type", "source", F.coalesce(F.col("status") == "declined", F.lit(False)).cast("int").alias("y")
    )
    return fx.label_distribution(rows, ["type", "source"])


# --- predicates ---------------------------------------------------------------------


@query(
    "P8_client_action",
    with_tape(f"select type, reason, count(*) as n, sum(({ACTION_SQL})::int)::bigint as actions from tape group by type, reason"),
)
def p8(spark, sf):
    return acts(spark, sf).groupBy("type", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("action").alias("actions")
    )


@query("P9_visit", with_tape(f"select id, client, t from tape where {VISIT_SQL}"))
def p9(spark, sf):
    return tape(spark, sf).filter(p.is_visit()).select("id", "client", "t")


@query("P10_target_action", with_tape(f"select id, type, {TARGET_SQL} as target from tape"))
def p10(spark, sf):
    rows = acts(spark, sf)
    return rows.select("id", "type", p.is_target_action(set(rows.columns)).alias("target"))


@query(
    "P11_scorable_rows",
    with_tape(f"select id, client, type, amount from tape where {OPERATION_SQL} and t >= {START + 60 * DAY}"),
)
def p11(spark, sf):
    return (
        tape(spark, sf).filter(p.is_operation() & (F.col("t") >= START + 60 * DAY)).select("id", "client", "type", "amount")
    )


@query(
    "P12_task_rows",
    with_tape(
        """select client, churned from labelled where in_population and active_90
 and client not in (select distinct client from tape where k = 33)""",
        ACTS, LABELS_CTE,
    ),
)
def p12(spark, sf):
    diverged = tape(spark, sf).filter("k = 33").select("client").distinct()
    return fx.task_rows(fx.churn_labels(tape(spark, sf), T), diverged).select("client", "churned")


# --- the whole table ----------------------------------------------------------------

FEATURES_CTE = f"""feat as (select client, {", ".join(_activity_sql() + _app_sql() + _flows_sql() + _money_sql() + _products_sql() + _bank_sql())},
 {_count('action', 30)} / nullif({_count('action', 90)}, 0) as act_trend_30_90
 from past group by client)"""
FEATURE_ROWS = """select f.*, coalesce(a.act_days_7, 0) as act_days_7, coalesce(a.act_days_30, 0) as act_days_30,
 coalesce(a.act_days_60, 0) as act_days_60, coalesce(a.act_days_90, 0) as act_days_90, a.act_gap_mean_90, a.act_gap_max_90,
 m.balance_total, m.balance_total_30d_ago, m.balance_total - m.balance_total_30d_ago as balance_change_30
 from feat f left join active a using (client) left join money m using (client)"""

PROFILE_FIELDS = ("region", "city", "income_type", "declared_income")
MILESTONES = ("bank_registered", "app_registered", "first_loan_opened")


# Everything the feature table holds of the profile; the four fields above are those that the tape changes.
ALL_FIELDS = (
    "family_status", "education", "region", "city", "housing_type", "income_type", "industry", "declared_income", "income_day", "children",
)
_NUMBERS = ("declared_income", "income_day", "children")


def profile_sql(cutoff, fields=PROFILE_FIELDS, milestones=MILESTONES):
    def value(f):
        return f"try_cast(nullif(c_{f}.old_value, '\\N') as bigint)" if f in _NUMBERS else f"nullif(c_{f}.old_value, '\\N')"

    rolled = ", ".join(f"case when c_{f}.client is not null then {value(f)} else s.{f} end as {f}_at" for f in fields)
    joins = " ".join(f"left join changed c_{f} on c_{f}.client = s.client and c_{f}.field_name = '{f}'" for f in fields)
    years = "date '1970-01-01' + birth_day::int"
    return f"""changed as (select client, field_name, arg_min(coalesce(old_value, '\\N'), (t, id)) as old_value
 from tape where type='profile_change' and t >= {cutoff} group by client, field_name),
rolled as (select s.*, {rolled} from snap s {joins}),
prof as (select client, gender, {", ".join(f"{f}_at as {f}" for f in fields)},
 cast(date_part('year', today) - date_part('year', born) - (strftime(today,'%m%d') < strftime(born,'%m%d'))::int as int) as age,
 case when income_type_at = 'salary' and job_recorded < {cutoff} then
  greatest(0, cast((date_part('year', today) - date_part('year', job))*12 + date_part('month', today) - date_part('month', job)
   - (date_part('day', today) < date_part('day', job))::int as int)) end as job_tenure_months,
 {", ".join(f"case when {m} < {cutoff} then ({cutoff} - {m}) / {float(DAY)!r} end as days_since_{m}" for m in milestones)}
 from (select *, make_timestamp({cutoff + LOCAL})::date as today, {years} as born, date '1970-01-01' + job_start_day::int as job from rolled))"""


@query(
    "H6_client_feature_table",
    with_tape(
        f"select p.* exclude (client), f.*, l.active_90, l.churned from ({FEATURE_ROWS}) f join labelled l using (client) left join prof p using (client) where l.in_population",
        SNAPSHOT, ACTS, PAST, DAYS_CTE, BALANCE_CTE, FEATURES_CTE, LABELS_CTE, profile_sql(T, ALL_FIELDS, ALL_MILESTONES),
    ),
)
def h6(spark, sf):
    from chronotape.operators.profile import profile_at

    rows = tape(spark, sf)
    table = fx.client_features(rows, T)
    labels = fx.churn_labels(rows, T).filter("in_population").drop("in_population")
    changes = rows.filter(F.col("type") == "profile_change")
    profile = profile_at(snapshot(spark, sf, ALL_MILESTONES), changes, T, ALL_FIELDS, ALL_MILESTONES)
    return labels.join(table, "client").join(profile, "client", "left")


@query(
    "P14_cutoff_rule",
    f"""select date_trunc('month', make_timestamp(max_t) - interval 60 day)::date as month_cutoff, make_timestamp(max_t)::date as data_end
 from (select epoch_us(max(ts)) as max_t from events)""",
)
def p14(spark, sf):
    from queries.tables import read

    end = read(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("end"))
    return end.select(
        F.trunc(F.col("end") - F.expr("interval 60 days"), "month").alias("month_cutoff"),
        F.col("end").cast("date").alias("data_end"),
    )

