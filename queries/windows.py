"""Window operators (W1-W23), as-of joins (J2-J5) and the operation features (H2, H7)."""

from pyspark.sql import functions as F

from chronotape.functions.clock import local_day
from chronotape.operators import operations as ops
from chronotape.operators import predicates as p
from chronotape.operators import windows as wx
from chronotape.operators.asof import asof, with_fallback
from chronotape.operators.features import with_actions
from chronotape.operators.predicates import kind, sure
from chronotape.operators.profile import first_changes
from chronotape.plans.split import Measure, plan_split, quantiles, rolling_sums, running
from queries.features import ACTION_SQL, ACTS, LOGIN_SQL, OPERATION_SQL, PURCHASE_SQL, VISIT_SQL
from queries.registry import query
from queries.tables import CUTOFF, DAY, END, HOUR, LOCAL, SNAPSHOT, START, read, snapshot, tape, with_tape

FRAMES = {"1h": HOUR, "1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY, "90d": 90 * DAY}


def _range(w):
    return f"(partition by client order by t range between {FRAMES[w]} preceding and 1 preceding)"


BEFORE = "(partition by client order by t range between unbounded preceding and 1 preceding)"


@query(
    "W1_rolling_count",
    with_tape("select id, " + ", ".join(f"count(*) filter (where {OPERATION_SQL}) over {_range(w)} as n_{w}" for w in FRAMES) + " from tape"),
)
def w1(spark, sf):
    rows = tape(spark, sf)
    n = F.when(p.is_operation(), F.lit(1).cast("bigint"))
    return rolling_sums(rows, plan_split(rows, ["client"], "t"), FRAMES, {"n": n}).select(
        "id", *[f"n_{w}" for w in FRAMES]
    )


@query(
    "W2_rolling_sum",
    with_tape("select id, " + ", ".join(f"coalesce(sum(amount) filter (where {OPERATION_SQL}) over {_range(w)}, 0)::bigint as s_{w}" for w in FRAMES) + " from tape"),
)
def w2(spark, sf):
    rows = tape(spark, sf)
    s = F.when(p.is_operation(), F.col("amount"))
    return rolling_sums(rows, plan_split(rows, ["client"], "t"), FRAMES, {"s": s}).select(
        "id", *[f"s_{w}" for w in FRAMES]
    )


@query(
    "W3_hours_since_previous",
    with_tape(f"select id, (t - max(t) filter (where {LOGIN_SQL}) over {BEFORE}) / {float(HOUR)!r} as hours from tape"),
)
def w3(spark, sf):
    rows = tape(spark, sf)
    found = running(rows, plan_split(rows, ["client"], "t"), [Measure("before", "max", F.when(p.is_login(), F.col("t")))])
    return found.select("id", ops.hours_between(F.col("t"), F.col("before")).alias("hours"))


@query(
    "W4_last_value",
    with_tape(
        f"""select id, (max(struct_pack(t := t, i := id, b := balance_after)) filter (where balance_after is not null) over {BEFORE}).b as balance
 from tape"""
    ),
)
def w4(spark, sf):
    rows = tape(spark, sf)
    packed = F.when(F.col("balance_after").isNotNull(), F.struct("t", "id", "balance_after"))
    return running(rows, plan_split(rows, ["client"], "t"), [Measure("last", "max", packed)]).select(
        "id", F.col("last.balance_after").alias("balance")
    )


@query("W5_running_maximum", with_tape(f"select id, max(amount) filter (where {OPERATION_SQL}) over {BEFORE} as largest from tape"))
def w5(spark, sf):
    rows = tape(spark, sf)
    amount = F.when(p.is_operation(), F.col("amount"))
    return running(rows, plan_split(rows, ["client"], "t"), [Measure("largest", "max", amount)]).select("id", "largest")


LOGGED = f"""logged as (select *, case when {OPERATION_SQL} then cast(round(ln(1 + coalesce(amount,0)::double) * 1000000) as bigint) end as l,
 cast(round(ln(1 + coalesce(amount,0)::double) * 1000000) as bigint) as own from tape)"""
ZROWS = f"""zrows as (select id, own, count(*) filter (where {OPERATION_SQL}) over {_range('90d')} as n,
 coalesce(sum(l) over {_range('90d')}, 0)::hugeint as s1, coalesce(sum(l::hugeint * l) over {_range('90d')}, 0)::hugeint as s2,
 {OPERATION_SQL} as scored from logged)"""
Z_SQL = "round(case when n >= 2 and n * s2 - s1 * s1 > 0 then (own - s1::double / n) / (sqrt((n * s2 - s1 * s1)::double) / n) end, 6)"


@query("W6_rolling_z_score", with_tape(f"select id, {Z_SQL} as z from zrows where scored", LOGGED, ZROWS))
def w6(spark, sf):
    rows = ops.history(tape(spark, sf)).filter(p.is_operation())
    return rows.select("id", ops.history_features()["log_amount_z_90d"].alias("z"))


def _novel(field, past, name):
    w = f"(partition by client, {field} order by t range between unbounded preceding and 1 preceding)"
    hours = f"case when {field} is not null then (t - max(t) filter (where {past}) over {w}) / {float(HOUR)!r} end"
    return f"{hours} as {name}_hours_since_prev, ({field} is not null and ({hours}) is null)::int as {name}_is_new"


OUTGOING = "type in ('transfer_out','p2p_out')"
NOVELTY_CTE = f"""novel as (select id, {OPERATION_SQL} as scored, {_novel('mcc', PURCHASE_SQL, 'mcc')},
 {_novel('merchant_name', PURCHASE_SQL, 'merchant')}, {_novel('merchant_country', PURCHASE_SQL, 'country')},
 {_novel('counterparty', OUTGOING, 'counterparty')} from tape)"""


@query("W7_novelty", with_tape("select * exclude (scored) from novel where scored and (mcc_is_new is not null)", NOVELTY_CTE))
def w7(spark, sf):
    rows = tape(spark, sf)
    scored = rows.filter(p.is_operation()).select("id").join(ops.novelty(rows), "id", "left")
    flags = {f"{n}_is_new": F.coalesce(F.col(f"{n}_is_new"), F.lit(0)) for n in ops.NOVELTY}
    return scored.withColumns(flags)


# --- stages of a customer, read from the priorities of its orders --------------------

STAGES = "stages as (select 'c' || cast(o_custkey as string) as client, o_orderkey as id, epoch_us(o_orderdate) as started_at, o_orderpriority as stage from orders)"
UNTIL = 978_307_200_000_000 + 365 * DAY  # 2002-01-01
MOMENT = 883_612_800_000_000             # 1998-01-01


def stages(spark, sf):
    return read(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("client"),
        F.col("o_orderkey").alias("id"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("started_at"),
        F.col("o_orderpriority").alias("stage"),
    )


@query(
    "W8_stage_at",
    f"""with {STAGES} select client, stage, started_at as stage_since from (select *, row_number() over (partition by client order by started_at desc, id desc) as rn
 from stages where started_at <= {MOMENT}) where rn = 1""",
)
def w8(spark, sf):
    return wx.stage_at(stages(spark, sf), MOMENT)


SPELLS = f"""spelled as (select client, id, started_at, stage, lead(stage) over w as next_stage, lead(started_at) over w is null as censored,
 coalesce(lead(started_at) over w, {UNTIL}) as ended_at, (coalesce(lead(started_at) over w, {UNTIL}) - started_at) / {float(DAY)!r} as days
 from stages window w as (partition by client order by started_at, id))"""


@query("W9_spells", f"with {STAGES}, {SPELLS} select * from spelled")
def w9(spark, sf):
    return wx.spells(stages(spark, sf), UNTIL)


WEEKS = f"""wk as (select client, (((t + {LOCAL}) // {DAY}) + 3) // 7 as week, count(*) filter (where {VISIT_SQL}) as n from tape group by 1, 2),
span as (select client, min(week) as lo, max(week) as hi from wk group by client),
grid as (select client, unnest(range(lo, hi + 1)) as week from span),
weeks as (select g.client, g.week, coalesce(k.n, 0) as n from grid g left join wk k on k.client = g.client and k.week = g.week),
flagged as (select *, (sum(n) over w4)::bigint as high_sum, count(*) over w4 = 4 and sum(n) over w4 >= 6 as high,
 (sum(n) over w2)::bigint as low_sum, count(*) over w2 = 2 and sum(n) over w2 <= 1 as low from weeks
 window w4 as (partition by client order by week rows between 3 preceding and current row),
 w2 as (partition by client order by week rows between 1 preceding and current row))"""


def weekly(spark, sf):
    weeks = wx.weekly_counts(tape(spark, sf), p.is_visit(), local_day(F.col("t")))
    return wx.trailing_flag(wx.trailing_flag(weeks, 4, 6, "high"), 2, 1, "low", at_most=True)


@query("W10_trailing_week_sum", with_tape("select * from flagged", WEEKS))
def w10(spark, sf):
    return weekly(spark, sf)


@query(
    "W11_runs",
    with_tape(
        """select client, week, low, case when low then row_number() over (partition by client, low, grp order by week) else 0 end as run_length,
 case when low then min(week) over (partition by client, low, grp) end as run_start
 from (select *, week - row_number() over (partition by client, low order by week) as grp from flagged)""",
        WEEKS,
    ),
)
def w11(spark, sf):
    return wx.run_lengths(weekly(spark, sf), "low", "run").select("client", "week", "low", "run_length", "run_start")


SILENCE = 20
END_DAY = (END + LOCAL) // DAY
FRICTION_SQL = "(coalesce(status,'')='declined' and coalesce(decline_reason,'')<>'insufficient_funds') or (type='app_operation' and coalesce(status,'')='failed') or type='case_opened'"
OWN_OUT_SQL = "type='transfer_out' and coalesce(counterparty,'')='Own account' and coalesce(status,'')='approved'"
DAILY = f"""daily as (select client, (t + {LOCAL}) // {DAY} as day, count(*) filter (where {ACTION_SQL}) as action,
 count(*) filter (where {FRICTION_SQL}) as friction, count(*) filter (where type='salary_credit') as salary,
 count(*) filter (where {OWN_OUT_SQL}) as own_out from tape group by 1, 2)"""


def daily_masks():
    declined = sure(F.col("status") == "declined")
    friction = (
        (declined & ~sure(F.col("decline_reason") == "insufficient_funds"))
        | (kind("app_operation") & sure(F.col("status") == "failed"))
        | kind("case_opened")
    )
    own_out = kind("transfer_out") & sure(F.col("counterparty") == p.OWN_ACCOUNT) & sure(F.col("status") == "approved")
    return {"action": F.col("action"), "friction": friction, "salary": kind("salary_credit"), "own_out": own_out}


def _span(name, left, right):
    return f"coalesce((select sum(d.{name}) from daily d where d.client = g.client and d.day >= g.start_day - {left} and d.day < g.start_day - {right}), 0)"


SILENCES = f"""gaps as (select client, day + 1 as start_day, nd, coalesce(nd, {END_DAY}) - day - 1 as silent_days from
 (select client, day, lead(day) over (partition by client order by day) as nd from daily where action > 0)),
silent as (select client, start_day, silent_days, nd is not null as returned, {_span('friction', 60, 0)} > 0 as friction,
 {_span('salary', 120, 60)} > 0 and {_span('salary', 60, 0)} = 0 as salary_stop,
 {_span('own_out', 60, 0)} > {_span('own_out', 120, 60)} as outflow_up,
 {_span('action', 90, 30)} > 0 and {_span('action', 30, 0)} / 30 < 0.5 * {_span('action', 90, 30)} / 60 as fading
 from gaps g where silent_days >= {SILENCE})"""


@query("W12_silences", with_tape("select * from silent", DAILY, SILENCES))
def w12(spark, sf):
    rows = with_actions(tape(spark, sf))
    daily = wx.daily_table(rows, local_day(F.col("t")), daily_masks())
    return wx.silences(daily, SILENCE, END_DAY)


PRIORITY = {
    "application_submitted": 0, "product_opened": 1, "salary_credit": 2, "cash_deposit": 3, "transfer_in": 4,
    "purchase": 5, "transfer_out": 6, "app_operation": 7,
}
REST = ("amount", "status", "reason", "channel", "counterparty")
# Equal moments are rare in the tape, so this check orders by the day.
RANK_SQL = "case type " + " ".join(f"when '{n}' then {r}" for n, r in PRIORITY.items()) + f" else {len(PRIORITY)} end"


@query(
    "W13_causal_order",
    with_tape(
        f"""select id, client, day, row_number() over (partition by client order by day, {RANK_SQL}, type nulls last, source nulls last,
 {", ".join(f"{c} nulls last" for c in sorted(REST))}, id) - 1 as ordinal from (select *, t // {DAY} as day from tape)"""
    ),
)
def w13(spark, sf):
    rows = tape(spark, sf).withColumn("t", F.floor(F.col("t") / F.lit(DAY)).cast("bigint"))
    return wx.causal_order(rows, PRIORITY, REST, "id").select("id", "client", F.col("t").alias("day"), "ordinal")


SIZED = "sized as (select *, 3 + k % 17 as n_tokens from tape)"
MAX_EVENTS, MAX_TOKENS = 40, 400


def sized(spark, sf):
    return tape(spark, sf).withColumn("n_tokens", 3 + F.col("k") % 17)


TAILED = f"""tailed as (select * from (select *, row_number() over w as back, sum(n_tokens) over w as back_tokens from sized
 window w as (partition by client order by t desc, id desc rows between unbounded preceding and current row))
 where back <= {MAX_EVENTS} and back_tokens <= {MAX_TOKENS})"""


@query("W14_recent_tail", with_tape("select id, client, n_tokens from tailed", SIZED, TAILED))
def w14(spark, sf):
    return wx.recent_tail(sized(spark, sf), MAX_EVENTS, MAX_TOKENS).select("id", "client", "n_tokens")


@query(
    "W14_over_limit_refused",
    with_tape(
        f"""select client, count(*) as n_events, sum(n_tokens)::bigint as n_tokens from sized group by client
 having count(*) > 60 or sum(n_tokens) > 700""",
        SIZED,
    ),
)
def w14_all(spark, sf):
    return wx.over_limit(sized(spark, sf), 60, 700)


@query(
    "W15_offsets",
    """select conv_id, turn, length(text)::bigint as n, (coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint as start
 from conversations""",
)
def w15(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return wx.offsets(rows, ["conv_id"], "turn", "n")


TRIP_GAP = 3 * DAY
TRIPS = f"""abroad as (select id, client, t, merchant_country, case when t - lag(t) over w > {TRIP_GAP} then 1 else 0 end as pause
 from tape where type='purchase' window w as (partition by client order by t, id)),
tripped as (select *, (sum(pause) over (partition by client order by t, id rows between unbounded preceding and current row))::bigint as trip from abroad)"""


@query("W16_trips", with_tape("select id, client, trip from tripped", TRIPS))
def w16(spark, sf):
    rows = tape(spark, sf).filter(kind("purchase")).select("id", "client", "t", "merchant_country")
    return wx.trips(rows, TRIP_GAP).select("id", "client", "trip")


@query(
    "W16_one_country_share",
    with_tape(
        """select count(*) as n_trips, count(*) filter (where n = 1) / count(*) as single from
 (select client, trip, count(distinct merchant_country) as n from tripped group by client, trip)""",
        TRIPS,
    ),
)
def w16_share(spark, sf):
    rows = tape(spark, sf).filter(kind("purchase")).select("id", "client", "t", "merchant_country")
    per = wx.trips(rows, TRIP_GAP).groupBy("client", "trip").agg(F.countDistinct("merchant_country").alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_trips"), (F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("single")
    )


FIRST_DAY = (START + LOCAL) // DAY
PAYDAY = f"""spend as (select client, (t + {LOCAL}) // {DAY} as day, coalesce(sum(amount) filter (where type='purchase'), 0)::bigint as spent,
 count(*) filter (where type='salary_credit') as paid from tape group by 1, 2)"""


@query(
    "W17_event_study",
    with_tape(
        f"""select client, day, coalesce(sum(spent) over (partition by client order by day range between 1 following and 5 following), 0)::bigint as after,
 coalesce(sum(spent) over (partition by client order by day range between 5 preceding and 1 preceding), 0)::bigint as before
 from spend qualify paid > 0 and day - 5 >= {FIRST_DAY} and day + 5 <= {END_DAY}""",
        PAYDAY,
    ),
)
def w17(spark, sf):
    daily = tape(spark, sf).groupBy("client", local_day(F.col("t")).alias("day")).agg(
        F.coalesce(F.sum(F.when(kind("purchase"), F.col("amount"))), F.lit(0)).alias("spent"),
        F.count_if(kind("salary_credit")).alias("paid"),
    )
    return wx.around_event(daily, "spent", "paid", 5, FIRST_DAY, END_DAY)


# --- telemetry-like series: one run per client, one step per event --------------------

STEPS = """steps as (select client, row_number() over (partition by client order by t, id) - 1 as step,
 cast(round(v * 100) as bigint) as loss from tape)"""


def steps(spark, sf):
    from chronotape.plans.split import number_rows

    rows = tape(spark, sf).select("client", "t", "id", F.round(F.col("v") * 100).cast("bigint").alias("loss"))
    return number_rows(rows, plan_split(rows, ["client"], "t"), ["id"], "step").select("client", "step", "loss")


@query(
    "W18_rolling_mean",
    with_tape(
        "select client, step, loss, sum(loss) over w / count(loss) over w as smooth from steps window w as (partition by client order by step rows between 4 preceding and current row)",
        STEPS,
    ),
)
def w18(spark, sf):
    return wx.smoothed(steps(spark, sf), ["client"], "step", "loss", 5, "smooth")


@query(
    "W19_thin_blocks",
    with_tape(
        """select client, step // size as block, max(step) as step, sum(loss) / count(*) as loss from
 (select *, cast(ceil(count(*) over (partition by client) / 10.0) as bigint) as size from steps) group by client, step // size""",
        STEPS,
    ),
)
def w19(spark, sf):
    return wx.thin_blocks(steps(spark, sf), ["client"], "step", "step", "loss", 10)


@query(
    "W19_thin_curve",
    with_tape(
        """select client, step, loss from (select *, greatest(1, cast(ceil(count(*) over (partition by client) / 15.0) as bigint)) as stride,
 max(step) over (partition by client) as last, row_number() over (partition by client order by loss, step) as rank from steps)
 where step % stride = 0 or step = last or rank = 1""",
        STEPS,
    ),
)
def w19_curve(spark, sf):
    return wx.thin_curve(steps(spark, sf), ["client"], "step", "loss", 15)


MONTHS = "months as (select o_orderstatus as status, year(o_orderdate) * 12 + month(o_orderdate) as month, median(cast(round(o_totalprice * 100) as bigint)) as med from orders group by 1, 2)"


def monthly_medians(spark, sf):
    rows = read(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("month"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    return quantiles(rows, ["status", "month"], "cents", {"med": 0.5})


@query(
    "W20_yearly_growth",
    f"with {MONTHS} select a.status, a.month, b.med / a.med - 1 as growth from months a join months b on b.status = a.status and b.month = a.month + 12",
)
def w20(spark, sf):
    return wx.growth(monthly_medians(spark, sf), ["status"], "month", "med", 12)


EDGES = (0.0, 1.0, 7.0, 30.0, 90.0, 365.0)
AGE_BIN = f"case when age <= 1 then 0 when age <= 7 then 1 when age <= 30 then 2 when age <= 90 then 3 when age <= 365 then 4 else 5 end"


@query(
    "W21_time_resolution",
    with_tape(
        f"""select age_bin, count(*) as pairs, count(*) filter (where gap = 0) as same_stamp, count(*) filter (where gap > 0 and gap <= 1) as within_1s,
 count(*) filter (where gap > 0 and gap <= 60) as within_60s, count(*) filter (where gap > 0 and a = b) as collapsed from
 (select {AGE_BIN} as age_bin, gap, a, b from (select ({CUTOFF} - m) / {float(DAY)!r} as age, (m - lag(m) over w) / 1e6 as gap,
 (8.0 * ln(1 + ({CUTOFF} - m) / 8e6))::float as a, (8.0 * ln(1 + ({CUTOFF} - lag(m) over w) / 8e6))::float as b
 from (select client, id, t // 60000000 * 60000000 as m, t from tape) where m < {CUTOFF} window w as (partition by client order by m, id)) where gap is not null)
 group by age_bin"""
    ),
)
def w21(spark, sf):
    # Whole minutes, so that equal stamps occur.
    minute = 60_000_000
    rows = tape(spark, sf).select("client", "id", (F.floor(F.col("t") / F.lit(minute)) * minute).cast("bigint").alias("t"))
    return wx.pair_resolution(rows, CUTOFF, EDGES)


@query(
    "W22_state_episodes",
    f"""with {STAGES}, relevant as (select *, lag(stage) over (partition by client order by started_at, id) as before from stages
 where stage in ('1-URGENT', '5-LOW')),
 turned as (select *, lead(started_at) over (partition by client order by started_at, id) as stop from relevant where before is null or before <> stage)
 select client, started_at as opened_at, coalesce(stop, {UNTIL}) as closed_at from turned where stage = '1-URGENT'""",
)
def w22(spark, sf):
    return wx.episodes(stages(spark, sf), "1-URGENT", "5-LOW", UNTIL)


CHANGES = "type='profile_change' and field_name in ('region','city','income_type','declared_income')"


@query(
    "W23_first_change",
    with_tape(
        f"""select client, field_name, old_value, t as changed_at from (select *, row_number() over (partition by client, field_name order by t, id) as rn
 from tape where {CHANGES} and t >= {CUTOFF}) where rn = 1"""
    ),
)
def w23(spark, sf):
    changes = tape(spark, sf).filter(kind("profile_change"))
    return first_changes(changes, CUTOFF, ops.PROFILE_FIELDS)


# --- as-of joins ----------------------------------------------------------------------


def region_changes(rows):
    return rows.filter(kind("profile_change") & sure(F.col("field_name") == "region")).select(
        "client", "t", "id", "old_value"
    )


FORWARD = f"""(select struct_pack(t := c.t, o := c.old_value) from tape c where c.client = r.client and c.type='profile_change'
 and c.field_name='region' and c.t >= r.t order by c.t, c.id limit 1)"""


@query(
    "J2_asof_forward",
    with_tape(
        f"""select r.id, m.o as old_value, m.t as changed_at, m is not null as hit from
 (select id, client, t, {FORWARD} as m from tape r where {OPERATION_SQL}) r"""
    ),
)
def j2(spark, sf):
    rows = tape(spark, sf)
    scored = rows.filter(p.is_operation()).select("id", "client", "t")
    changes = region_changes(rows).withColumn("changed_at", F.col("t"))
    changes = changes.withColumnRenamed("id", "change_id")
    return asof(
        scored, changes, ["client"], "t", ["old_value", "changed_at"], direction="forward", tie="change_id"
    ).select("id", "old_value", "changed_at", "hit")


@query(
    "J3_asof_backward_strict",
    with_tape(
        f"""select r.id, l.t as login_at, l.status from (select id, client, t from tape where {OPERATION_SQL}) r
 asof left join (select client, t, arg_max(status, id) as status from tape where {LOGIN_SQL} group by client, t) l on l.client = r.client and l.t < r.t"""
    ),
)
def j3(spark, sf):
    rows = tape(spark, sf)
    scored = rows.filter(p.is_operation()).select("id", "client", "t")
    logins = rows.filter(p.is_login()).select(
        "client", "t", F.col("t").alias("login_at"), "status", F.col("id").alias("login_id")
    )
    return asof(scored, logins, ["client"], "t", ["login_at", "status"], exact=False, tie="login_id").select(
        "id", "login_at", "status"
    )


@query(
    "J4_asof_backward_exact",
    with_tape(
        f"""select r.id, b.balance_after as balance from (select id, client, t from tape where type='product_closed') r
 asof left join (select client, t, arg_max(balance_after, id) as balance_after from tape where balance_after is not null group by client, t) b
 on b.client = r.client and b.t <= r.t"""
    ),
)
def j4(spark, sf):
    rows = tape(spark, sf)
    closed = rows.filter(kind("product_closed")).select("id", "client", "t")
    balances = rows.filter("balance_after is not null").select(
        "client", "t", F.col("balance_after").alias("balance"), F.col("id").alias("b_id")
    )
    return asof(closed, balances, ["client"], "t", ["balance"], tie="b_id").select("id", "balance")


AT_ROWS = f"""moved as (select r.id, case when r.m is not null then r.m.o else s.region end as region_at, r.m is not null as hit
 from (select id, client, {FORWARD} as m from tape r where {OPERATION_SQL}) r left join snap s on s.client = r.client)"""


@query("J5_snapshot_fallback", with_tape("select * from moved", SNAPSHOT, AT_ROWS))
def j5(spark, sf):
    rows = tape(spark, sf)
    scored = rows.filter(p.is_operation()).select("id", "client", "t")
    changes = region_changes(rows).withColumnRenamed("id", "change_id")
    found = asof(scored, changes, ["client"], "t", ["old_value"], direction="forward", tie="change_id")
    snap = snapshot(spark, sf).select("client", "region")
    return found.join(snap, "client", "left").select(
        "id", with_fallback("hit", "old_value", "region").alias("region_at"), "hit"
    )


# --- the operation feature table ------------------------------------------------------

ELIGIBLE_FROM = START + 60 * DAY


def _roll(value, w, filter_sql=None):
    f = f" filter (where {filter_sql})" if filter_sql else ""
    return f"count(*){f} over {_range(w)}" if value is None else f"coalesce(sum({value}){f} over {_range(w)}, 0)::bigint"


_declined = f"{OPERATION_SQL} and coalesce(status,'')='declined'"
_online = f"{OPERATION_SQL} and coalesce(is_online,false)"
_foreign = f"{OPERATION_SQL} and coalesce(merchant_country,'KZ')<>'KZ'"
_failed = f"{LOGIN_SQL} and coalesce(status,'')='failed'"
_newdev = f"{LOGIN_SQL} and coalesce(device_new,false)"
_alert = "type='fraud_alert'"
_block = "type='card_blocked' and coalesce(reason,'')='fraud_suspicion'"
_income = "type in ('salary_credit','pension_credit','other_income_credit')"
_parts = [f"{_roll(None, w, OPERATION_SQL)} as txn_count_{w}" for w in FRAMES]
_parts += [f"{_roll('amount', w, OPERATION_SQL)} as txn_sum_{w}" for w in FRAMES]
for _name, _mask in (("declined_count", _declined), ("login_count", LOGIN_SQL), ("login_failed", _failed), ("new_device_login", _newdev)):
    _parts += [f"{_roll(None, w, _mask)} as {_name}_{w}" for w in ("1h", "1d")]
_parts += [
    f"{_roll(None, '1d', _online)} as online_count_1d", f"{_roll(None, '1d', _foreign)} as foreign_count_1d",
    f"{_roll(None, '90d', _foreign)} as foreign_90", f"{_roll(None, '1d', _alert)} as fraud_alert_1d",
    f"{_roll(None, '30d', _alert)} as fraud_alert_30d", f"{_roll(None, '30d', _block)} as fraud_block_30d",
    f"{_roll('amount', '90d', _income)} as income_sum_90d",
    f"(t - max(t) filter (where {OPERATION_SQL}) over {BEFORE}) / {float(HOUR)!r} as txn_hours_since_prev",
    f"(t - max(t) filter (where {LOGIN_SQL}) over {BEFORE}) / {float(HOUR)!r} as login_hours_since_prev",
    f"(t - max(t) filter (where {_newdev}) over {BEFORE}) / {float(HOUR)!r} as new_device_hours_since_prev",
    f"max(coalesce(amount,0)) filter (where {OPERATION_SQL}) over {BEFORE} as largest",
    f"""(max(struct_pack(t := t, i := id, b := balance_after)) filter (where balance_after is not null and type in
 ('purchase','transfer_out','p2p_out','cash_withdrawal','cash_deposit','bill_payment','salary_credit','pension_credit','other_income_credit','transfer_in','p2p_in'))
 over {BEFORE}).b as balance_before""",
]
HISTORY = f"hist as (select *, {', '.join(_parts)} from tape)"


def _at(field):
    return FORWARD.replace("c.field_name='region'", f"c.field_name='{field}'")


PROFILE_ROWS = f"""prof as (select id, s.gender, s.birth_day, s.bank_registered, s.app_registered, p.t,
 case when mr is not null then mr.o else s.region end as region, case when mc is not null then mc.o else s.city end as city,
 case when mi is not null then mi.o else s.income_type end as income_type,
 case when md is not null then try_cast(md.o as bigint) else s.declared_income end as declared_income
 from (select id, client, t, {_at('region')} as mr, {_at('city')} as mc, {_at('income_type')} as mi, {_at('declared_income')} as md
  from tape r where {OPERATION_SQL} and t >= {ELIGIBLE_FROM}) p left join snap s on s.client = p.client)"""

_local = f"make_timestamp(h.t + {LOCAL})"
_born = "(date '1970-01-01' + p.birth_day::int)"
H7_SQL = with_tape(
    f"""select h.id, h.client, h.t, (h.type='transfer_out')::int as is_transfer, (coalesce(h.reason,'')='own_transfer')::int as own_transfer,
 coalesce(h.channel,'NA') as channel, coalesce(h.is_online,false)::int as is_online, h.amount, round(ln(1 + h.amount::double), 9) as log_amount,
 (coalesce(h.original_currency,'KZT')<>'KZT')::int as foreign_currency, coalesce(h.merchant_country,'NA') as merchant_country,
 (coalesce(h.merchant_country,'KZ')<>'KZ')::int as is_foreign, coalesce(h.mcc,'NA') as mcc, coalesce(h.merchant_category,'NA') as merchant_category, coalesce(h.merchant_name,'NA') as merchant_name,
 hour({_local})::int as hour, (isodow({_local}) - 1)::int as weekday, day({_local})::int as day_of_month,
 {", ".join(f"h.txn_count_{w}, h.txn_sum_{w}" for w in FRAMES)},
 h.declined_count_1h, h.declined_count_1d, h.login_count_1h, h.login_count_1d, h.login_failed_1h, h.login_failed_1d,
 h.new_device_login_1h, h.new_device_login_1d, h.online_count_1d, h.foreign_count_1d,
 h.foreign_90 / nullif(h.txn_count_90d, 0) as foreign_share_90d,
 case when h.txn_sum_90d > 0 then coalesce(h.amount,0) / (h.txn_sum_90d / nullif(h.txn_count_90d, 0)) end as amount_to_mean_90d,
 z.z as log_amount_z_90d, case when h.largest > 0 then coalesce(h.amount,0) / h.largest end as amount_to_max_prev,
 h.txn_hours_since_prev, h.login_hours_since_prev, h.new_device_hours_since_prev, h.fraud_alert_1d, h.fraud_alert_30d, h.fraud_block_30d,
 h.income_sum_90d, h.balance_before, case when h.balance_before > 0 then h.amount / h.balance_before end as amount_to_balance,
 n.* exclude (id, scored),
 cast(date_part('year', {_local}) - date_part('year', {_born}) - (strftime({_local},'%m%d') < strftime({_born},'%m%d'))::int as int) as age,
 coalesce(p.gender,'NA') as gender, coalesce(p.region,'NA') as region, coalesce(p.income_type,'NA') as income_type, p.declared_income,
 (h.merchant_city is not null and p.city is not null and h.merchant_city <> p.city)::int as merchant_city_other,
 case when h.t > p.bank_registered then (h.t - p.bank_registered) / {float(DAY)!r} end as days_since_bank_registered,
 case when h.t > p.app_registered then (h.t - p.app_registered) / {float(DAY)!r} end as days_since_app_registered
 from hist h join prof p on p.id = h.id join novel n on n.id = h.id left join (select id, {Z_SQL} as z from zrows) z on z.id = h.id""",
    SNAPSHOT, HISTORY, NOVELTY_CTE, PROFILE_ROWS, LOGGED, ZROWS,
)


@query("H7_operation_features", H7_SQL)
def h7(spark, sf):
    return ops.operation_features(tape(spark, sf), snapshot(spark, sf), ELIGIBLE_FROM)


@query(
    "H2_profile_at_rows",
    with_tape("select id, region, city, income_type, declared_income from prof", SNAPSHOT, PROFILE_ROWS),
)
def h2(spark, sf):
    rows = ops.profile_at_rows(tape(spark, sf)).filter(p.is_operation() & (F.col("t") >= ELIGIBLE_FROM))
    snap = snapshot(spark, sf)
    types = dict(snap.dtypes)
    snap = snap.select("client", *[F.col(f).alias(f"snap_{f}") for f in ops.PROFILE_FIELDS])
    return rows.join(snap, "client", "left").select(
        "id",
        *[
            F.when(F.col(f"{f}_hit"), F.col(f"{f}_old").try_cast(types[f])).otherwise(F.col(f"snap_{f}")).alias(f)
            for f in ops.PROFILE_FIELDS
        ],
    )


_ = ACTS
