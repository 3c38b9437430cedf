"""Scorecard of the derived tape (K1-K8) and its SQL."""

from pyspark.sql import functions as F

from chronotape.functions import clock
from chronotape.operators import joins as jx
from chronotape.operators import predicates as p
from chronotape.operators import scorecard as sc
from chronotape.operators import windows as wx
from chronotape.operators.asof import asof
from chronotape.operators.predicates import kind, sure
from chronotape.operators.profile import age_at
from chronotape.plans.split import quantiles
from queries.registry import query
from queries.tables import DAY, END, LOCAL, SNAPSHOT, START, read, snapshot, stored_tape, tape, with_tape
from queries.windows import MONTHS, monthly_medians

SPENT = "(type='purchase' and coalesce(status,'')='approved')"


def spent():
    return kind("purchase") & sure(F.col("status") == "approved")


def _ok(low, high):
    return lambda v: (v >= low) & (v <= high)


def payments(spark, sf):
    return tape(spark, sf).filter(spent())


SOURCES = {
    "one_merchant": "(select count(*) filter (where d = 1) / count(*) from (select client, count(*) as n, count(distinct merchant_name) as d from tape where " + SPENT + " group by client having count(*) >= 6))",
    "prices": f"(select median(most) from (select merchant_name, max(d) as most from (select merchant_name, strftime(make_timestamp(t + {LOCAL}), '%Y-%m') as m, count(distinct amount) as d from tape where {SPENT} group by 1, 2) where merchant_name in (select merchant_name from tape where {SPENT} group by 1 having count(*) >= 20) group by 1))",
    "named": "(select avg((coalesce(counterparty,'') <> 'Payer 0')::int) from tape where type='transfer_in')",
}


@query(
    "K2_identity",
    with_tape(
        f"""select 'one merchant' as key, {SOURCES['one_merchant']}::double as value, '>= 0.85' as target, {SOURCES['one_merchant']} >= 0.85 as ok
 union all select 'prices per month', {SOURCES['prices']}::double, '<= 4', {SOURCES['prices']} <= 4 union all select 'named payer', {SOURCES['named']}::double, '1', {SOURCES['named']} = 1"""
    ),
)
def k2(spark, sf):
    rows = payments(spark, sf)
    month = F.date_format(clock.local_timestamp(F.col("t")), "yyyy-MM")
    named = tape(spark, sf).filter(kind("transfer_in"))
    return sc.card(
        [
            sc.metric(sc.one_provider_share(rows, "merchant_name", 6), "one merchant", ">= 0.85", lambda v: v >= 0.85),
            sc.metric(sc.prices_per_month(rows, "merchant_name", month, "amount", 20), "prices per month", "<= 4", lambda v: v <= 4),
            sc.metric(
                sc.share(named, F.coalesce("counterparty", F.lit("")) != "Payer 0"), "named payer", "1", lambda v: v == 1
            ),
        ]
    )


QUIET_BEFORE = END - 100 * DAY


@query(
    "K3_broken_chains",
    with_tape(
        f"""select key, value::double as value, '0' as target, value = 0 as ok from (select 'clients without account' as key, count(*) as value from (select client from snap except select client from tape where account_id is not null)
 union all select 'declined without account', count(*) filter (where account_id is null) / count(*) from tape where coalesce(status,'')='declined'
 union all select 'opened never used', count(*) from (select contract_id from tape where type='product_opened' except select contract_id from tape where type in ('loan_payment','product_closed'))
 union all select 'silent debts', count(*) from (select contract_id, max(t) as last_t, arg_max(days_past_due, (t, id)) as outstanding from tape where type in ('loan_payment','installment_missed') group by 1)
  where last_t < {QUIET_BEFORE} and outstanding > 0 and contract_id not in (select contract_id from tape where type='product_closed'))""",
        SNAPSHOT,
    ),
)
def k3(spark, sf):
    rows = tape(spark, sf)
    closed = rows.filter(kind("product_closed"))
    accounts = rows.filter("account_id is not null").select("client").distinct()
    opened = rows.filter(kind("product_opened")).select("contract_id").distinct()
    used = rows.filter(kind("loan_payment", "product_closed")).select("contract_id").distinct()
    loans = rows.filter(kind("loan_payment", "installment_missed")).withColumn("outstanding", F.col("days_past_due"))
    zero = lambda v: v == 0
    return sc.card(
        [
            sc.metric(sc.count(jx.without(snapshot(spark, sf).select("client"), accounts, ["client"])), "clients without account", "0", zero),
            sc.metric(sc.share(rows.filter(sure(F.col("status") == "declined")), F.col("account_id").isNull()), "declined without account", "0", zero),
            sc.metric(sc.count(jx.without(opened, used, ["contract_id"])), "opened never used", "0", zero),
            sc.metric(sc.count(sc.silent_debts(loans, closed, QUIET_BEFORE)), "silent debts", "0", zero),
        ]
    )


LOCAL_T = f"make_timestamp(t + {LOCAL})"


@query(
    "K4_calendar",
    with_tape(
        f"""select key, value, target, case key when 'first of month' then value <= 1.2 when 'date peak' then value >= 1.3 when 'season' then value between 0.2 and 0.6 when 'weekend' then value <= 0.3 else value <= 0.2 end as ok from
 (select 'first of month' as key, (select avg(n) filter (where day(d) = 1) / avg(n) filter (where day(d) <> 1) from days) as value, '<= 1.2' as target
 union all select 'date peak', (select avg(n) filter (where month(d) = 6 and day(d) = 15) / avg(n) filter (where month(d) = 6 and abs(day(d) - 15) >= 7) from days), '>= 1.3'
 union all select 'season', (select avg((month({LOCAL_T}) between 8 and 12)::int) from tape where type='purchase'), '0.2-0.6'
 union all select 'weekend', (select avg((isodow({LOCAL_T}) >= 6)::int) from tape where type='salary_credit'), '<= 0.3'
 union all select 'night', (select avg((hour({LOCAL_T}) < 7)::int) from tape where type='card_blocked'), '<= 0.2')""",
        f"days as (select {LOCAL_T}::date as d, count(*) as n from tape group by 1)",
    ),
)
def k4(spark, sf):
    rows = tape(spark, sf)
    moment = clock.local_timestamp(F.col("t"))
    date = clock.local_date(F.col("t"))
    first = F.dayofmonth("date") == 1
    return sc.card(
        [
            sc.metric(sc.by_day_ratio(rows, date, first), "first of month", "<= 1.2", lambda v: v <= 1.2),
            sc.metric(sc.date_peak(rows, date, 6, 15), "date peak", ">= 1.3", lambda v: v >= 1.3),
            sc.metric(sc.share(rows.filter(kind("purchase")), F.month(moment).between(8, 12)), "season", "0.2-0.6", _ok(0.2, 0.6)),
            sc.metric(sc.share(rows.filter(kind("salary_credit")), F.weekday(moment) >= 5), "weekend", "<= 0.3", lambda v: v <= 0.3),
            sc.metric(sc.share(rows.filter(kind("card_blocked")), F.hour(moment) < 7), "night", "<= 0.2", lambda v: v <= 0.2),
        ]
    )


AGE = f"(date_part('year', make_timestamp({END})) - date_part('year', date '1970-01-01' + birth_day::int) - (strftime(make_timestamp({END} + {LOCAL}), '%m%d') < strftime(date '1970-01-01' + birth_day::int, '%m%d'))::int)"


@query(
    "K5_segment_lift",
    with_tape(
        f"""select * from (select 'online F to M' as key, (count(*) filter (where gender='F' and is_online) / count(*) filter (where gender='F')) / (count(*) filter (where gender<>'F' and is_online) / count(*) filter (where gender<>'F')) as value, '>= 1' as target from g) a
 join (select 'online F to M' as key, null::boolean as ok) using (key) union all
 select 'foreign at 65+', (select count(*) filter (where n > 0) / count(*) from (select client, count(*) filter (where coalesce(merchant_country,'KZ') <> 'KZ') as n from g where age >= 50 group by client)), '<= 0.05',
 (select count(*) filter (where n > 0) / count(*) from (select client, count(*) filter (where coalesce(merchant_country,'KZ') <> 'KZ') as n from g where age >= 50 group by client)) <= 0.05""",
        SNAPSHOT, f"g as (select t.*, s.gender, {AGE} as age from tape t join snap s on s.client = t.client where {SPENT})",
    ),
)
def k5(spark, sf):
    snap = snapshot(spark, sf).select("client", "gender", age_at(F.col("birth_day"), F.lit(END)).alias("age"))
    rows = payments(spark, sf).join(snap, "client")
    return sc.card(
        [
            sc.metric(sc.segment_lift(rows, F.col("gender") == "F", sure(F.col("is_online"))), "online F to M", ">= 1"),
            sc.metric(sc.any_use_share(rows, F.col("age") >= 50, p.is_foreign()), "foreign at 65+", "<= 0.05", lambda v: v <= 0.05),
        ]
    )


@query(
    "K6_price_drift",
    f"""with {MONTHS}, grown as (select b.med / a.med - 1 as growth from months a join months b on b.status = a.status and b.month = a.month + 12),
 rates as (select month, median(cents) as median from (select year(o_orderdate) * 12 + month(o_orderdate) as month, round(o_totalprice * 100)::bigint as cents from orders) group by 1)
 select 'yearly growth' as key, round((select median(growth) from grown), 9) as value, '0.05-0.15' as target, (select median(growth) between 0.05 and 0.15 from grown) as ok
 union all select 'monthly variation', round((select stddev_samp(median) / avg(median) from rates), 9), '>= 0.02', (select stddev_samp(median) / avg(median) >= 0.02 from rates)""",
)
def k6(spark, sf):
    grown = wx.growth(monthly_medians(spark, sf), ["status"], "month", "med", 12)
    orders = read(spark, sf, "orders").select("o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    rows = sc.card(
        [
            sc.metric(quantiles(grown, [], "growth", {"value": 0.5}), "yearly growth", "0.05-0.15", _ok(0.05, 0.15)),
            sc.metric(sc.monthly_variation(orders, month, "cents"), "monthly variation", ">= 0.02", lambda v: v >= 0.02),
        ]
    )
    return rows.withColumn("value", F.round("value", 9))


@query(
    "K7_rate_by_state",
    with_tape(
        """select 'missed when alerted' as key, (count(*) filter (where state and type='installment_missed') / count(*) filter (where state)) / (count(*) filter (where not state and type='installment_missed') / count(*) filter (where not state)) as value,
 '>= 1.5' as target, (count(*) filter (where state and type='installment_missed') / count(*) filter (where state)) / (count(*) filter (where not state and type='installment_missed') / count(*) filter (where not state)) >= 1.5 as ok from
 (select d.type, coalesce(s.v > 150, false) as state from (select * from tape where type in ('installment_missed','loan_payment')) d asof left join (select client, t, arg_max(v, id) as v from tape where type='fraud_alert' group by 1, 2) s on s.client = d.client and s.t <= d.t)"""
    ),
)
def k7(spark, sf):
    rows = tape(spark, sf)
    due = rows.filter(kind("installment_missed", "loan_payment")).select("id", "client", "t", "type")
    alerts = rows.filter(kind("fraud_alert")).select("client", "t", F.col("v").alias("level"), F.col("id").alias("a_id"))
    state = asof(due, alerts, ["client"], "t", ["level"], tie="a_id").withColumn("high", sure(F.col("level") > 150))
    ratio = sc.rate_ratio(state, kind("installment_missed"), F.col("high"), ~F.col("high"))
    return sc.metric(ratio, "missed when alerted", ">= 1.5", lambda v: v >= 1.5)


EPISODES = f"""eps as (select client, t as a, coalesce((select min(o.t) from tape o where o.client = e.client and o.type='case_opened' and o.t > e.t), {END}) as b from tape e where type='fraud_alert')"""
NEAR = "type='transfer_out' and coalesce(counterparty,'')='Own account'"


@query(
    "K8_episode_shares",
    with_tape(
        f"""select count(*) as episodes, count(*) filter (where i > 0 and s = 0) / count(*) as income_without_spending, count(*) filter (where l > 0) / count(*) as left_near_start from
 (select (select count(*) from tape x where x.client = e.client and x.type in ('salary_credit','pension_credit','other_income_credit') and x.t >= a and x.t < b) as i,
 (select count(*) from tape x where x.client = e.client and {SPENT} and x.t >= a and x.t < b) as s,
 (select count(*) from tape x where x.client = e.client and {NEAR} and x.t >= a - {30 * DAY} and x.t < a + {DAY}) as l from eps e)""",
        EPISODES,
    ),
)
def k8(spark, sf):
    rows = stored_tape(spark, sf)
    opened = rows.filter(kind("fraud_alert")).select(F.col("id").alias("row"), "client", "t")
    ended = jx.first_after(opened, rows.filter(kind("case_opened")), ["client"])
    spans = ended.select("row", "client", F.col("t").alias("start"), F.coalesce("stopped_at", F.lit(END)).alias("stop"))
    leaving = kind("transfer_out") & sure(F.col("counterparty") == p.OWN_ACCOUNT)
    return sc.episode_shares(spans, rows, kind(*p.INCOME_TYPES), spent(), leaving, DAY)


def cards(spark, sf):
    rows = tape(spark, sf)
    half = START + 180 * DAY

    def card(part):
        return sc.card(
            [
                sc.metric(sc.share(part.filter(kind("purchase")), F.col("status") == "declined"), "declined purchases", "<= 0.4", lambda v: v <= 0.4),
                sc.metric(sc.count(part.filter("type = 'fraud_alert' and k > 90")), "high alerts", "0", lambda v: v == 0),
                sc.metric(sc.share(part, F.col("amount").isNotNull()), "rows with amount", "any"),
            ]
        )

    return card(rows.filter(F.col("t") < half)), card(rows.filter(F.col("t") >= half))


def _card_sql(where):
    return f"""select 'declined purchases' as key, count(*) filter (where coalesce(status,'')='declined') / count(*) as value, '<= 0.4' as target, count(*) filter (where coalesce(status,'')='declined') / count(*) <= 0.4 as ok from tape where type='purchase' and {where}
 union all select 'high alerts', count(*)::double, '0', count(*) = 0 from tape where type='fraud_alert' and k > 90 and {where} union all select 'rows with amount', count(amount) / count(*), 'any', null from tape where {where}"""


HALF = START + 180 * DAY
CARDS = f"card_a as ({_card_sql(f't < {HALF}')}), card_b as ({_card_sql(f't >= {HALF}')})"


@query("K1_before_after", with_tape("select b.key, a.value as before, b.value, b.target, b.ok from card_b b left join card_a a using (key)", CARDS))
def k1(spark, sf):
    return sc.before_after(*cards(spark, sf))


@query("K1_passed", with_tape("select count(*) filter (where ok) as passed, count(ok) as judged, count(*) as metrics from card_b", CARDS))
def k1_passed(spark, sf):
    return sc.passed(cards(spark, sf)[1])


