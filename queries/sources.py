"""Scans, payload parsing and sinks (S1-S15), set operations (U1-U5), sorts and limits (T1-T6)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotape.functions import values as vx
from chronotape.operators.predicates import kind
from chronotape.plans.shared import new_path
from chronotape.plans.split import number_rows, plan_split
from chronotape.sources import raw as rx
from chronotape.sources import sinks
from queries.registry import query
from queries.tables import CUTOFF, LOCAL, RAW, SNAPSHOT, raw, read, snapshot, tape, with_tape

# Declared payload fields of the derived export: type -> field -> (dtype, required).
MONEY = {"amount": ("int", True), "channel": ("str", False), "status": ("str", False), "k": ("int", True)}
CATALOGUE: rx.Catalogue = {
    "purchase": {**MONEY, "is_online": ("bool", True)},
    **{t: dict(MONEY) for t in ("transfer_out", "cash_withdrawal", "bill_payment", "salary_credit", "cash_deposit", "transfer_in", "loan_payment")},
    "app_operation": {"status": ("str", True), "k": ("int", True)},
    "communication_sent": {"channel": ("str", True), "k": ("int", True)},
    **{t: {"k": ("int", True)} for t in ("app_screen", "banner_clicked", "profile_change", "case_opened", "application_submitted", "fraud_alert", "card_blocked", "installment_missed", "product_opened", "product_closed")},
}


def _sql_catalogue():
    rows = [
        f"('{t}','{f}','{d}',{str(r).lower()})" for t, fields in CATALOGUE.items() for f, (d, r) in fields.items()
    ]
    return f"catalogue(type, field, dtype, required) as (values {', '.join(rows)})"


CATALOGUE_CTE = _sql_catalogue()
# A payload as an object with its event type; broken ones have neither.
PARSED = """parsed as (select *, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as obj from raw),
kinds as (select *, case when json_type(obj, '$.type') = 'VARCHAR' then obj->>'$.type' end as ptype from parsed)"""


@query("S1_envelope_scan", "select event_type, count(*) as n, min(event_id) as first_id from events group by event_type")
def s1(spark, sf):
    rows = spark.read.schema("event_id bigint, event_type string").parquet(f"{sf}/events.parquet")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    "S2_nested_snapshot",
    f"""with {SNAPSHOT} select client, (app_registered is not null)::int + 1 + (first_loan_opened is not null)::int as n_milestones,
 least(app_registered, bank_registered, first_loan_opened) as first_milestone, job_start_day from snap""",
)
def s2(spark, sf):
    path = new_path(spark, "snapshot")
    sinks.write_table(snapshot(spark, sf), path)
    rows = spark.read.parquet(path)
    return rows.select(
        "client",
        F.size("lifelong").alias("n_milestones"),
        F.array_min(F.transform("lifelong", lambda x: x["t"])).alias("first_milestone"),
        F.col("employment")[0]["start_day"].alias("job_start_day"),
    )


@query(
    "S3_manifest_contract",
    """with m as (select 3 as schema_version, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') as period_start, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '+05:00' as period_end from events)
 select 'unsupported version' as problem from m where schema_version <> 2 union all select 'missing profile_rows' union all select 'unreadable period_start'""",
)
def s3(spark, sf):
    from chronotape.operators.checks import manifest_problems

    iso = "yyyy-MM-dd'T'HH:mm:ss"
    header = read(spark, sf, "events").agg(
        F.lit(3).alias("schema_version"),
        F.date_format(F.min("ts"), iso).alias("period_start"),
        F.concat(F.date_format(F.max("ts"), iso), F.lit("+05:00")).alias("period_end"),
        F.count(F.lit(1)).alias("events_rows"),
    )
    path = new_path(spark, "manifest")
    sinks.write_report(header, path, "json")
    return manifest_problems(rx.read_manifest(spark, path), 2)


@query(
    "S4_typed_payload",
    with_tape(
        """select k.id, k.ptype as type, case when json_type(obj,'$.amount') in ('BIGINT','UBIGINT') and c.amount then (obj->>'$.amount')::bigint end as amount,
 case when json_type(obj,'$.channel')='VARCHAR' and c.channel then obj->>'$.channel' end as channel,
 case when json_type(obj,'$.status')='VARCHAR' and c.status then obj->>'$.status' end as status,
 case when json_type(obj,'$.is_online')='BOOLEAN' and c.online then (obj->>'$.is_online')::boolean end as is_online,
 case when json_type(obj,'$.k') in ('BIGINT','UBIGINT') and c.k then (obj->>'$.k')::bigint end as k
 from kinds k left join (select type, bool_or(field='amount') as amount, bool_or(field='channel') as channel, bool_or(field='status') as status,
 bool_or(field='is_online') as online, bool_or(field='k') as k from catalogue group by type) c on c.type = k.ptype""",
        RAW, PARSED, CATALOGUE_CTE,
    ),
)
def s4(spark, sf):
    return rx.typed_payload(raw(spark, sf), CATALOGUE).select("id", "type", "amount", "channel", "status", "is_online", "k")


@query("S5_event_type", with_tape("select ptype as type, count(*) as n from kinds group by ptype", RAW, PARSED))
def s5(spark, sf):
    kinds = raw(spark, sf).select(rx.event_type_of(F.col("payload")).alias("type"))
    return kinds.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S6_pruned_payload",
    with_tape(
        "select id, case when json_type(obj,'$.amount') in ('BIGINT','UBIGINT') then (obj->>'$.amount')::bigint end as amount, obj->>'$.channel' as channel from kinds",
        RAW, PARSED,
    ),
)
def s6(spark, sf):
    return rx.pruned_payload(raw(spark, sf).select("id", "payload"), "amount bigint, channel string").select(
        "id", "amount", "channel"
    )


@query(
    "S7_client_blocks",
    with_tape("select client, id, row_number() over (partition by client order by t, id) - 1 as place from tape"),
)
def s7(spark, sf):
    # Blocks are range partitions in order; a client's rows continue from one block to the next.
    blocks = rx.client_blocks(tape(spark, sf).select("client", "t", "id"))
    return number_rows(blocks, plan_split(blocks, ["client"], "t"), ["id"], "place").select("client", "id", "place")


@query("S8_row_numbers", "select event_id, row_number() over (order by event_id) - 1 as raw_row from events")
def s8(spark, sf):
    return rx.row_numbers(read(spark, sf, "events").select("event_id"), "event_id")


@query("S9_parquet_sink", with_tape("select id, client, t, type, amount from tape"))
def s9(spark, sf):
    path = new_path(spark, "tape")
    sinks.write_table(tape(spark, sf).select("id", "client", "t", "type", "amount"), path)
    return spark.read.parquet(path)


@query("S10_sink_by_source", with_tape("select source, count(*) as n, sum(id)::bigint as ids from tape group by source"))
def s10(spark, sf):
    path = new_path(spark, "by-source")
    sinks.write_by_source(tape(spark, sf).select("id", "client", "t", "type", "source"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "S11_past_future_split",
    with_tape(
        f"""select 'past' as side, client, count(*) as n from tape where t < {CUTOFF} group by client
 union all select 'future', client, count(*) from tape where t >= {CUTOFF} and client not in (select client from tape where k = 33) group by client"""
    ),
)
def s11(spark, sf):
    rows = tape(spark, sf)
    before, after = rx.split_at(rows, CUTOFF, rows.filter("k = 33").select("client").distinct())
    sides = before.select(F.lit("past").alias("side"), "client").unionByName(
        after.select(F.lit("future").alias("side"), "client")
    )
    return sides.groupBy("side", "client").agg(F.count(F.lit(1)).alias("n"))


@query("S12_point_lookup", "select event_id, event_type, value from events where user_id = 42")
def s12(spark, sf):
    return read(spark, sf, "events").filter(F.col("user_id") == 42).select("event_id", "event_type", "value")


@query(
    "S13_local_time_scan",
    f"select o_orderkey, epoch_us(o_orderdate) + {LOCAL} as at, o_orderpriority as state from orders",
)
def s13(spark, sf):
    rows = read(spark, sf, "orders").select(
        "o_orderkey",
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"),
        F.col("o_orderpriority").alias("state"),
    )
    return rx.shifted(rows, "at", LOCAL)


# Telemetry lines made of the events: one run per user; some lines are broken by rule.
LINES_RULE = """case when k = 3 then '{"kind":"step","st' when k = 4 then '   ' when k = 5 then '[]'
 else '{"kind":"step","step":' || cast(id as string) || ',"loss":' || cast(k as string) || '}' end"""
LINES = f"lines as (select id, u, {LINES_RULE} as value from tape)"


def lines(spark, sf):
    return tape(spark, sf).selectExpr("id", "u", f"{LINES_RULE} as value")


@query(
    "S14_jsonl_scan",
    with_tape(
        """select count(*) filter (where ok) as records, count(*) filter (where not ok) as malformed,
 (sum((value->>'$.loss')::bigint) filter (where ok))::bigint as loss from
 (select coalesce(json_type(case when json_valid(value) then value end)='OBJECT', false) as ok, case when json_valid(value) then value end as value from lines where trim(value) <> '')""",
        LINES,
    ),
)
def s14(spark, sf):
    rows = rx.read_jsonl(lines(spark, sf), "kind string, step bigint, loss bigint")
    return rows.agg(
        F.count_if(F.col("malformed").isNull()).alias("records"),
        F.count_if(F.col("malformed").isNotNull()).alias("malformed"),
        F.sum("loss").alias("loss"),
    )


@query("S15_report_sinks", with_tape("select type, count(*) as n from tape group by type"))
def s15(spark, sf):
    path = new_path(spark, "report")
    sinks.write_report(tape(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n")), path, "csv")
    return spark.read.csv(path, header=True, schema="type string, n bigint")


# --- set operations -------------------------------------------------------------------


@query(
    "U1_union_of_types",
    with_tape(
        """select id, type, amount, mcc, null::varchar as counterparty, null::bigint as days_past_due from tape where type='purchase'
 union all select id, type, amount, null, counterparty, null from tape where type='transfer_out'
 union all select id, type, amount, null, null, days_past_due from tape where type='loan_payment'"""
    ),
)
def u1(spark, sf):
    rows = tape(spark, sf)
    purchase = rows.filter(kind("purchase")).select("id", "type", "amount", "mcc")
    transfer = rows.filter(kind("transfer_out")).select("id", "type", "amount", "counterparty")
    loan = rows.filter(kind("loan_payment")).select("id", "type", "amount", "days_past_due")
    return purchase.unionByName(transfer, allowMissingColumns=True).unionByName(loan, allowMissingColumns=True)


@query(
    "U2_client_union",
    with_tape("select count(*) as clients from (select client from tape union select client from snap)", SNAPSHOT),
)
def u2(spark, sf):
    both = tape(spark, sf).select("client").union(snapshot(spark, sf).select("client")).distinct()
    return both.agg(F.count(F.lit(1)).alias("clients"))


@query(
    "U3_difference_both_ways",
    with_tape(
        """select 'tape only' as side, client from (select client from tape except select client from snap)
 union all select 'snapshot only', client from (select client from snap except select client from tape)""",
        SNAPSHOT,
    ),
)
def u3(spark, sf):
    a, b = tape(spark, sf).select("client"), snapshot(spark, sf).select("client")
    return a.subtract(b).select(F.lit("tape only").alias("side"), "client").unionByName(
        b.subtract(a).select(F.lit("snapshot only").alias("side"), "client")
    )


@query(
    "U4_intersection",
    with_tape("select count(*) as both_keys from (select id from tape where channel is not null intersect select id from tape where amount is not null)"),
)
def u4(spark, sf):
    rows = tape(spark, sf)
    both = rows.filter("channel is not null").select("id").intersect(rows.filter("amount is not null").select("id"))
    return both.agg(F.count(F.lit(1)).alias("both_keys"))


@query(
    "U5_tagged_concat",
    with_tape(f"select 'past' as grp, id, client from tape where t < {CUTOFF} union all select 'future', id, client from tape where t >= {CUTOFF}"),
)
def u5(spark, sf):
    rows = tape(spark, sf)
    past, future = rx.split_at(rows, CUTOFF)
    return past.select(F.lit("past").alias("grp"), "id", "client").unionByName(
        future.select(F.lit("future").alias("grp"), "id", "client")
    )


# --- sorts, limits, top-k -------------------------------------------------------------


@query(
    "T1_total_order",
    with_tape(
        """select id, row_number() over (order by source nulls last, type nulls last, amount nulls last, client, t, id) - 1 as place from tape"""
    ),
)
def t1(spark, sf):
    rows = tape(spark, sf).select("id", "source", "type", "amount", "client", "t")
    # The place in a total order: a distributed sort by the same keys, numbered per range of the first key.
    ranked = rows.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("source").asc_nulls_last(), F.col("type").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per (source, type): a declared catalogue, not data.
    starts = ranked.select("source", "type", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    keyed = rows.withColumn("_amount", F.coalesce(F.col("amount"), F.lit(2**62)))
    split = plan_split(keyed, ["source", "type"], "_amount")
    numbered = number_rows(keyed, split, ["client", "t", "id"], "_place")
    return numbered.join(starts, ["source", "type"]).select("id", (F.col("start") + F.col("_place")).alias("place"))


@query(
    "T2_typed_domain_order",
    with_tape(
        """select vtype, value, row_number() over (order by rank, num nulls last, value) - 1 as place from (select distinct vtype, value,
 case vtype when 'bool' then 0 when 'int' then 1 when 'float' then 2 else 3 end as rank, case when vtype in ('int','float') then value::double end as num from
 (select 'int' as vtype, cast(k as string) as value from tape union all select 'bool', cast(is_online as string) from tape where is_online is not null
 union all select 'str', channel from tape where channel is not null))"""
    ),
)
def t2(spark, sf):
    rows = tape(spark, sf)
    found = (
        rows.select(F.lit("int").alias("vtype"), F.col("k").cast("string").alias("value"))
        .unionByName(rows.filter("is_online is not null").select(F.lit("bool").alias("vtype"), F.col("is_online").cast("string").alias("value")))
        .unionByName(rows.filter("channel is not null").select(F.lit("str").alias("vtype"), F.col("channel").alias("value")))
        .distinct()
    )
    return vx.typed_places(found).select("vtype", "value", "place")


@query(
    "T3_client_timeline",
    with_tape(
        f"""select id, t, type, month from (select id, t, type, strftime(make_timestamp(t + {LOCAL}), '%Y-%m') as month from tape
 where client = 'c42' and t < {CUTOFF} order by t desc, id desc limit 20)"""
    ),
)
def t3(spark, sf):
    from chronotape.functions.clock import local_timestamp

    rows = tape(spark, sf).filter((F.col("client") == "c42") & (F.col("t") < CUTOFF))
    last = rows.orderBy(F.col("t").desc(), F.col("id").desc()).limit(20)
    return last.select("id", "t", "type", F.date_format(local_timestamp(F.col("t")), "yyyy-MM").alias("month"))


@query(
    "T3_totals_by_type",
    with_tape("select client, type, count(*) as n, coalesce(sum(amount),0)::bigint as total from tape group by client, type"),
)
def t3_totals(spark, sf):
    return tape(spark, sf).groupBy("client", "type").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total")
    )


@query("T4_busiest_client", "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 1")
def t4(spark, sf):
    counts = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "user_id").limit(1)


@query(
    "T5_top_values",
    with_tape(
        """select type, merchant_name, n, place from (select type, merchant_name, n, row_number() over (partition by type order by n desc, merchant_name) as place from
 (select type, merchant_name, count(*) as n from tape where merchant_name is not null group by 1, 2)) where place <= 5"""
    ),
)
def t5(spark, sf):
    counts = tape(spark, sf).filter("merchant_name is not null").groupBy("type", "merchant_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("type").orderBy(F.col("n").desc(), "merchant_name")
    return counts.withColumn("place", F.row_number().over(order)).filter("place <= 5")


@query(
    "T6_cost_deciles",
    """select decile, count(*) as n, sum(cost)::bigint as cost, min(cost) as lo, max(cost) as hi from
 (select n_chars as cost, (row_number() over (order by n_chars, doc_id) - 1) * 10 // (select count(*) from documents) as decile from documents) group by decile""",
)
def t6(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("cost"))
    return vx.cost_groups(rows, "cost", "doc_id", 10)


