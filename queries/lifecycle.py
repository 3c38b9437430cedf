"""Profiles, lifecycle and calendar cubes (H1, H3-H5, H8-H11, A30-A37, A42, P6, P13, P15, F5-F9, F14) and their SQL."""

from pyspark.sql import functions as F

from chronotape.functions import clock
from chronotape.functions.hashing import uniform
from chronotape.functions.values import as_declared
from chronotape.operators import evaluate as vx
from chronotape.operators import features as fx
from chronotape.operators import lifecycle as lx
from chronotape.operators import profile as px
from chronotape.operators import volumes as vol
from chronotape.operators import windows as wx
from chronotape.operators.predicates import is_visit, kind
from chronotape.plans.shared import written
from chronotape.plans.split import quantiles
from queries.features import ACTION_SQL, ACTS, MILESTONES, PROFILE_FIELDS, VISIT_SQL, profile_sql
from queries.registry import query
from queries.tables import CUTOFF, DAY, END, FAMILIES, LOCAL, SNAPSHOT, families, read, snapshot, tape, with_tape
from queries.windows import END_DAY, FIRST_DAY, SPELLS, STAGES, UNTIL, daily_masks, stages


@query("H1_profile_roll_back", with_tape("select client, region, city, income_type, declared_income from prof", SNAPSHOT, profile_sql(CUTOFF)))
def h1(spark, sf):
    changes = tape(spark, sf).filter(kind("profile_change"))
    return px.roll_back(snapshot(spark, sf), changes, CUTOFF, PROFILE_FIELDS).select("client", *PROFILE_FIELDS)


@query("H3_age_and_tenure", with_tape("select client, age, job_tenure_months from prof", SNAPSHOT, profile_sql(CUTOFF)))
def h3(spark, sf):
    changes = tape(spark, sf).filter(kind("profile_change"))
    return px.profile_at(snapshot(spark, sf), changes, CUTOFF, PROFILE_FIELDS, MILESTONES).select(
        "client", "age", "job_tenure_months"
    )


@query(
    "H4_days_since_milestones",
    f"with {SNAPSHOT} select client, " + ", ".join(f"case when {m} < {CUTOFF} then ({CUTOFF} - {m}) / {float(DAY)!r} end as {m}" for m in MILESTONES) + " from snap",
)
def h4(spark, sf):
    return snapshot(spark, sf).select("client", *[px.days_since_milestone(m, CUTOFF).alias(m) for m in MILESTONES])


SNAP_FIELDS = ("gender", "region", "city", "income_type", "declared_income", "birth_day", "age", "relationship_months")


@query(
    "H5_attribute_policy",
    with_tape(
        f"""select field, case when field = 'relationship_months' then 'excluded_shortcut' when field = 'age' then 'derived'
 when field in (select distinct field_name from tape where type='profile_change') then 'changed_by_event' else 'constant' end as policy
 from (values {", ".join(f"('{f}')" for f in SNAP_FIELDS)}) t(field)"""
    ),
)
def h5(spark, sf):
    fields = spark.createDataFrame([(f,) for f in SNAP_FIELDS], "field string")
    changed = tape(spark, sf).filter(kind("profile_change")).select(F.col("field_name").alias("field"))
    return px.attribute_policy(fields, changed, ["age"], ["relationship_months"])


RULES = lx.Rules(high_visits=3, high_run=2, low_visits=1)


@query("H8_lifecycle_stages")
def h8(spark, sf):
    # The window has fewer visits than a bank's: the weekly thresholds are lower, the rules the same.
    return lx.transitions(tape(spark, sf), lx.registrations(snapshot(spark, sf)), families(spark, sf), END, RULES)


@query(
    "H8_daily_facts",
    with_tape(
        f"""select client, day, premium, held >= 2 and debit > 0 as two_products, last_action from (select d.client, d.day,
 (select count(*) from held h where h.client = d.client and h.premium and h.from_day <= d.day and d.day < h.to_day) > 0 as premium,
 (select count(*) from held h where h.client = d.client and h.from_day <= d.day and d.day < h.to_day) as held,
 (select count(*) from held h where h.client = d.client and h.family = 'debit_card' and h.from_day <= d.day and d.day < h.to_day) as debit,
 greatest(d.app_registered, coalesce((select max(t) from acts a where a.client = d.client and a.action and a.t >= d.app_registered and (a.t + {LOCAL}) // {DAY} <= d.day), 0)) as last_action
 from (select client, app_registered, unnest(range((app_registered + {LOCAL}) // {DAY}, {END_DAY})) as day from snap where app_registered < {END} and client in (select client from tape)) d)""",
        SNAPSHOT, ACTS, FAMILIES,
        f"""owned as (select *, lead(day) over (partition by client, contract_id order by t, id) as next_day from (select t.client, t.contract_id, t.t, t.id, (t.t + {LOCAL}) // {DAY} as day,
 t.type, f.family, f.premium from tape t left join families f on f.product_id = t.product_id where t.contract_id is not null
 and ((t.type = 'product_opened' and f.family is not null and f.family <> 'service') or t.type = 'product_closed')))""",
        """held as (select client, family, premium, day as from_day, coalesce(next_day, 1000000) as to_day from owned where type = 'product_opened')""",
    ),
)
def h8_facts(spark, sf):
    rows = tape(spark, sf)
    known = lx.registrations(snapshot(spark, sf)).join(rows.select("client").distinct(), "client", "left_semi")
    facts = lx.daily_facts(rows, known, families(spark, sf), END, lx.Rules(high_run=0))
    return facts.select("client", "day", "premium", F.col("core").alias("two_products"), "last_action")


@query("H9_registration", f"with {SNAPSHOT} select client, app_registered as registered from snap where app_registered is not null")
def h9(spark, sf):
    return lx.registrations(snapshot(spark, sf))


@query(
    "H10_products_held",
    with_tape(
        f"""select client, contract_id, product_id, family from (select t.*, f.family, row_number() over (partition by client, contract_id order by t, id desc) as rn, max(t) over (partition by client, contract_id) as mt,
 row_number() over (partition by client, contract_id order by t desc, id desc) as back from tape t left join families f on f.product_id = t.product_id where contract_id is not null and t < {CUTOFF}
 and ((type = 'product_opened' and f.family is not null and f.family <> 'service') or type = 'product_closed')) where back = 1 and type = 'product_opened'""",
        FAMILIES,
    ),
)
def h10(spark, sf):
    return lx.held_at(tape(spark, sf), families(spark, sf), CUTOFF)


# Stages of a customer from its orders, with the order status as the reason of a stage.
REASONED = """reasoned as (select s.*, o.o_orderstatus as reason, lag(s.stage) over (partition by s.client order by s.started_at, s.id) as previous_stage
 from spelled s join orders o on o.o_orderkey = s.id)"""


def reasoned(spark, sf):
    from chronotape.plans.split import plan_split, previous

    rows = stages(spark, sf).join(
        read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("reason")), "id"
    )
    rows = previous(rows, plan_split(rows, ["client"], "started_at"), {"previous_stage": "stage"}, ["id"])
    return wx.spells(rows, UNTIL, ("reason", "previous_stage"))


@query(
    "H11_risk_outcomes",
    f"""with {STAGES}, {SPELLS}, {REASONED} select reason, previous_stage, count(*) filter (where not censored and next_stage <> '5-LOW') as recovered,
 count(*) filter (where not censored and next_stage = '5-LOW') as churn, count(*) filter (where censored) as open from reasoned where stage = '1-URGENT' group by 1, 2""",
)
def h11(spark, sf):
    return lx.outcomes(reasoned(spark, sf), "1-URGENT", "5-LOW")


MONTH_STARTS = "mstarts as (select (year(m) * 12 + month(m) - 1)::bigint as month, epoch_us(m) - 18000000000 as moment from (select unnest(generate_series(timestamp '1995-02-01', timestamp '2001-12-01', interval 1 month)) as m))"


@query(
    "A30_stage_by_month",
    f"""with {STAGES}, {SPELLS}, {MONTH_STARTS}, cells as (select m.month, s.client, s.stage from spelled s join mstarts m on s.started_at <= m.moment and m.moment < s.ended_at)
 select month, stage, count(*) as n, count(*) / sum(count(*)) over (partition by month) as share from cells group by month, stage""",
)
def a30(spark, sf):
    months = spark.sql(
        "select (year(m) * 12 + month(m) - 1) as month, unix_micros(cast(m as timestamp)) - 18000000000 as moment from "
        "(select explode(sequence(date '1995-02-01', date '2001-12-01', interval 1 month)) as m)"
    )
    cells = lx.stage_at_months(wx.spells(stages(spark, sf), UNTIL), months)
    return lx.stage_shares(cells).withColumn("month", F.col("month").cast("bigint"))


@query(
    "A31_spell_quantiles",
    f"""with {STAGES}, {SPELLS} select stage, quantile_cont(days, 0.25) as p25, quantile_cont(days, 0.5) as p50, quantile_cont(days, 0.75) as p75, quantile_cont(days, 0.9) as p90
 from spelled where not censored group by stage""",
)
def a31(spark, sf):
    done = wx.spells(stages(spark, sf), UNTIL).filter("not censored").select("stage", "days")
    return quantiles(written(done, "spells"), ["stage"], "days", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})


MEASURES = ("n_all", "action", "visit", "purchase", "declined", "salary", "comm")
CUBE = f"""dayrows as (select client, (t + {LOCAL}) // {DAY} as day, count(*) as n_all, count(*) filter (where {ACTION_SQL}) as action, count(*) filter (where {VISIT_SQL}) as visit,
 count(*) filter (where type='purchase') as purchase, count(*) filter (where status='declined') as declined, count(*) filter (where type='salary_credit') as salary,
 count(*) filter (where type='communication_sent') as comm from tape group by 1, 2),
cube as (select g.client, g.day, {", ".join(f"coalesce(d.{m}, 0) as {m}" for m in MEASURES)} from (select client, unnest(range({FIRST_DAY}, {END_DAY})) as day from (select distinct client from tape)) g
 left join dayrows d on d.client = g.client and d.day = g.day)"""
MONTHLY = "monthly as (select client, (year(x) * 12 + month(x) - 1)::bigint as month, " + ", ".join(f"sum({m})::bigint as {m}" for m in MEASURES) + " from (select *, date '1970-01-01' + day::int as x from cube) group by 1, 2)"


def cube(spark, sf):
    rows = fx.with_actions(tape(spark, sf))
    masks = {
        "n_all": F.lit(True), "action": F.col("action"), "visit": is_visit(), "purchase": kind("purchase"),
        "declined": F.col("status") == "declined", "salary": kind("salary_credit"), "comm": kind("communication_sent"),
    }
    daily = wx.daily_table(rows, clock.local_day(F.col("t")), masks)
    return vol.day_cube(daily, rows, FIRST_DAY, END_DAY - 1, MEASURES)


@query("A32_day_cube", with_tape("select * from cube", CUBE))
def a32(spark, sf):
    return cube(spark, sf)


@query(
    "A33_volume_card",
    with_tape(
        "select avg(n_all) as mean, avg((n_all = 0)::int) as zero_month_share, avg((action = 0 and n_all > 0)::int) as no_action_month_share, "
        + ", ".join(f"quantile_cont(n_all, {q / 100}) as p{q}" for q in (10, 25, 50, 75, 90, 95, 99)) + " from monthly",
        CUBE, MONTHLY,
    ),
)
def a33(spark, sf):
    months = written(vol.monthly(cube(spark, sf), MEASURES), "months")
    return vol.volume_card(months, "n_all", "action")


MOMENTS = [FIRST_DAY + d for d in (90, 120, 150, 180, 210, 240, 270, 300)]


@query(
    "A34_silence_after",
    with_tape(
        f"""select round(avg(s), 9) as share from (select m, count(*) filter (where b > 0 and a = 0) / count(*) filter (where b > 0) as s from
 (select m, client, coalesce(sum(action) filter (where day >= m - 90 and day < m), 0) as b, coalesce(sum(action) filter (where day >= m and day < m + 30), 0) as a
 from cube, (values {", ".join(f"({m})" for m in MOMENTS)}) t(m) group by 1, 2) group by m)""",
        CUBE,
    ),
)
def a34(spark, sf):
    return vol.silence_after(cube(spark, sf), MOMENTS, 90, 30).select(F.round("share", 9).alias("share"))


WEEKLY = f"weekly as (select client, (day - {FIRST_DAY}) // 7 as week, sum(action) as n from cube group by 1, 2 having week < 51)"


@query(
    "A35_weekly_autocorrelation",
    with_tape(
        "select " + ", ".join(f"round(corr(x, l{n}), 9) as lag{n}" for n in (1, 4, 13)) + " from (select x, " + ", ".join(f"lag(x, {n}) over (partition by client order by week) as l{n}" for n in (1, 4, 13))
        + " from (select client, week, ln(1 + n::double) as x from weekly))",
        CUBE, WEEKLY,
    ),
)
def a35(spark, sf):
    found = vol.autocorrelation(vol.weekly(cube(spark, sf), FIRST_DAY, 51, "action"), (1, 4, 13))
    return found.select(*[F.round(f"lag{n}", 9).alias(f"lag{n}") for n in (1, 4, 13)])


TYPES = ("purchase", "app_operation", "salary_credit", "case_opened")


@query(
    "A36_type_profile",
    with_tape(
        "select client, " + ", ".join(
            [f"round(ln(1 + (count(*) filter (where type='{n}' and t >= {CUTOFF - w * DAY}))::double), 9) as {n}_{w}" for n in TYPES for w in (7, 30, 90)]
            + [f"round(ln(1 + least(365.0, coalesce(({CUTOFF} - max(t) filter (where type='{n}')) / {float(DAY)!r}, 365.0))), 9) as {n}_recency" for n in TYPES]
        ) + f" from tape where t < {CUTOFF} group by client"
    ),
)
def a36(spark, sf):
    found = vol.type_profile(tape(spark, sf), TYPES, CUTOFF, (7, 30, 90), DAY)
    return found.select("client", *[F.round(c, 9).alias(c) for c in found.columns if c != "client"])


BIN = "case when n < 10 then '0-9' when n < 50 then '10-49' when n < 70 then '50-69' else '70+' end"


@query(
    "A37_metric_breakdown",
    with_tape(
        f"""select bin, source, type, grouping(bin, source, type)::bigint as level, count(*) as n, sum(k)::bigint / count(*) as mean_loss, avg((k % 3 = 0)::int) as hit_rate from
 (select e.*, {BIN} as bin from tape e join (select client, count(*) as n from tape group by client) c using (client)) group by grouping sets ((bin), (source), (type))"""
    ),
)
def a37(spark, sf):
    rows = tape(spark, sf)
    lengths = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    scored = rows.join(lengths, "client").select(
        vx.history_bin(F.col("n"), (10, 50, 70)).alias("bin"), "source", "type", F.col("k").alias("loss"), (F.col("k") % 3 == 0).alias("hit")
    )
    return vx.breakdown(scored, ["bin", "source", "type"])


@query(
    "P6_before_after_split",
    with_tape(f"select client, count(*) filter (where t < {CUTOFF}) as before, count(*) filter (where t >= {CUTOFF}) as after from tape group by client"),
)
def p6(spark, sf):
    rows = tape(spark, sf)
    before = fx.past(rows, CUTOFF).groupBy("client").agg(F.count(F.lit(1)).alias("before"))
    after = rows.filter(F.col("t") >= CUTOFF).groupBy("client").agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, "client", "full_outer").fillna(0)


@query(
    "P13_negative_sampling",
    with_tape(
        """select id, y, case when y = 1 then 1 else 10 end as weight from (select id, coalesce(status='declined', false)::int as y,
 cast('0x' || substr(sha256(concat_ws(chr(31), 'negatives', cast(id as varchar))), 1, 13) as bigint) as h from tape) where y = 1 or h % 10 = 0"""
    ),
)
def p13(spark, sf):
    rows = tape(spark, sf).select("id", F.coalesce(F.col("status") == "declined", F.lit(False)).cast("int").alias("y"))
    return fx.sampled_negatives(rows, "id", 10).select("id", "y", "weight")


WINDOWS_CTE = f"""wins as (select source as grp, min(t) as history_start, max(t) as final_cutoff, min(t) + (count(*) * 1000000) as target_start, max(t) - (count(*) % 7 - 3) * {DAY} as target_end from tape group by source)"""


@query(
    "P15_nested_windows",
    with_tape("select grp, history_start <= target_start and target_start < target_end and target_end <= final_cutoff as valid from wins", WINDOWS_CTE),
)
def p15(spark, sf):
    n = F.count(F.lit(1))
    windows = tape(spark, sf).groupBy(F.col("source").alias("grp")).agg(
        F.min("t").alias("history_start"),
        F.max("t").alias("final_cutoff"),
        (F.min("t") + n * 1_000_000).alias("target_start"),
        (F.max("t") - (n % 7 - 3) * DAY).alias("target_end"),
    )
    return windows.select("grp", fx.valid_window().alias("valid"))


# --- scalar functions over whole tables -------------------------------------------------


@query(
    "F2_value_text",
    "select event_id, cast(user_id as varchar) as as_int, case when user_id % 2 = 0 then 'true' else 'false' end as as_bool, event_type as as_str from events",
)
def f2(spark, sf):
    from chronotape.functions.values import value_text

    return read(spark, sf, "events").select(
        "event_id",
        value_text(F.col("user_id")).alias("as_int"),
        value_text(F.col("user_id") % 2 == 0).alias("as_bool"),
        value_text(F.col("event_type")).alias("as_str"),
    )


@query(
    "F3_as_declared",
    with_tape(
        r"""select id, case when regexp_full_match(new_value, '\s*[+-]?\d+\s*') then try_cast(trim(new_value) as bigint) end as as_int,
 case when lower(trim(flag)) in ('true','1','yes') then true when lower(trim(flag)) in ('false','0','no') then false end as as_bool
 from (select id, new_value, case k % 7 when 0 then 'yes' when 1 then ' True ' when 2 then '0' when 3 then 'no' when 4 then 'maybe' when 5 then '1' end as flag from tape)"""
    ),
)
def f3(spark, sf):
    flag = F.expr("case k % 7 when 0 then 'yes' when 1 then ' True ' when 2 then '0' when 3 then 'no' when 4 then 'maybe' when 5 then '1' end")
    return tape(spark, sf).select(
        "id",
        as_declared(F.col("new_value"), "bigint").alias("as_int"),
        as_declared(flag, "boolean").alias("as_bool"),
    )


ISO = "strftime(make_timestamp(t + 18000000000), '%Y-%m-%dT%H:%M:%S.%f') || '+05:00'"


@query("F4_iso_time", with_tape("select id, t as parsed from tape"))
def f4(spark, sf):
    from chronotape.sources.raw import parse_time

    text = F.concat(
        F.date_format(F.timestamp_micros(F.col("t") + 18000000000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:00")
    )
    return tape(spark, sf).select("id", parse_time(text).alias("parsed"))


@query(
    "F5_local_calendar",
    with_tape(
        f"""select id, d as day, (d + 1) * {DAY} - {LOCAL} as end_of_day, d - (d + 3) % 7 as monday, (year(x) * 12 + month(x) - 1)::int as month from
 (select id, (t + {LOCAL}) // {DAY} as d, make_timestamp(t + {LOCAL}) as x from tape)"""
    ),
)
def f5(spark, sf):
    t = F.col("t")
    day = clock.local_day(t)
    return tape(spark, sf).select(
        "id",
        day.alias("day"),
        clock.end_of_day(day).alias("end_of_day"),
        clock.monday(day).alias("monday"),
        clock.month_number(t).alias("month"),
    )


@query(
    "F6_full_years_and_months",
    """select l_orderkey, l_linenumber, (date_part('year', s) - date_part('year', o) - (strftime(s, '%m%d') < strftime(o, '%m%d'))::int)::int as years,
 ((date_part('year', s) - date_part('year', o)) * 12 + date_part('month', s) - date_part('month', o) - (date_part('day', s) < date_part('day', o))::int)::int as months
 from (select l_orderkey, l_linenumber, l_shipdate::date as s, o_orderdate::date as o from lineitem join orders on o_orderkey = l_orderkey)""",
)
def f6(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    start, end = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return rows.select(
        "l_orderkey", "l_linenumber", clock.full_years(start, end).alias("years"), clock.full_months(start, end).alias("months")
    )


@query(
    "F7_tenure_label",
    "select o_orderkey, cast(m // 6 * 6 as varchar) || '-' || cast(m // 6 * 6 + 5 as varchar) as label from (select o_orderkey, o_orderkey % 240 as m from orders)",
)
def f7(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", clock.tenure_label(F.col("o_orderkey") % 240).alias("label"))


def _wave(phase):
    return [f"round(sin({phase} * 2.0::double * pi()), 9)", f"round(cos({phase} * 2.0::double * pi()), 9)"]


@query(
    "F8_calendar_channel",
    with_tape(
        "select id, " + ", ".join(
            f"{wave} as {name}_{kind_}" for name, phase in (
                ("hour", f"(((t + {LOCAL}) % {DAY}) / 3600000000.0::double / 24)"),
                ("weekday", f"((isodow(make_timestamp(t + {LOCAL})) - 1) / 7)"),
                ("month_day", f"((day(make_timestamp(t + {LOCAL})) - 1) / 31)"),
            ) for kind_, wave in zip(("sin", "cos"), _wave(phase))
        ) + " from tape"
    ),
)
def f8(spark, sf):
    found = tape(spark, sf).select("id", *clock.calendar_channel(F.col("t")))
    return found.select("id", *[(F.round(c, 9) + 0.0).alias(c) for c in found.columns if c != "id"])


@query(
    "F9_log_time",
    with_tape(
        f"select id, round(8 * ln(1 + s / 8), 9) as log_age, round(8 * (exp(8 * ln(1 + s / 8) / 8) - 1), 3) as back from (select id, ({CUTOFF} - t) / 1e6 as s from tape where t < {CUTOFF})"
    ),
)
def f9(spark, sf):
    log_age = clock.log_time((F.lit(CUTOFF) - F.col("t")) / F.lit(1e6))
    return tape(spark, sf).filter(F.col("t") < CUTOFF).select(
        "id", F.round(log_age, 9).alias("log_age"), F.round(clock.linear_time(log_age), 3).alias("back")
    )


@query(
    "F11_hash_uniform",
    "select event_id, cast('0x' || substr(sha256(concat_ws(chr(31), 'seed', cast(event_id as varchar), event_type)), 1, 13) as bigint) / 4503599627370496.0 as u from events",
)
def f11(spark, sf):
    return read(spark, sf, "events").select("event_id", uniform("seed", F.col("event_id"), F.col("event_type")).alias("u"))


@query(
    "F12_text_predicates",
    r"""select doc_id, text like 'The%' as starts, contains(text, 'data') as has, regexp_matches(text, '[0-9]{3}-[0-9]{4}') as signature from documents""",
)
def f12(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id",
        F.col("text").startswith("The").alias("starts"),
        F.col("text").contains("data").alias("has"),
        F.col("text").rlike("[0-9]{3}-[0-9]{4}").alias("signature"),
    )


@query(
    "F14_milestone_arrays",
    f"""with {SNAPSHOT} select client, case when app_registered < {CUTOFF} then app_registered end as first_app,
 (bank_registered < {CUTOFF})::int + coalesce((app_registered < {CUTOFF})::int, 0) + coalesce((first_loan_opened < {CUTOFF})::int, 0) as known from snap""",
)
def f14(spark, sf):
    return snapshot(spark, sf).select(
        "client",
        px.milestone_moment("app_registered", CUTOFF).alias("first_app"),
        F.size(F.filter("lifelong", lambda x: x["t"] < CUTOFF)).alias("known"),
    )


