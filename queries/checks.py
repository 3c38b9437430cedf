"""Contract and integrity checks (Q1-Q29 but those of encoded data) and their SQL."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotape.functions.clock import local_day
from chronotape.operators import checks as cx
from chronotape.operators import windows as wx
from chronotape.operators.predicates import kind
from chronotape.sources import raw as rx
from queries.registry import query
from queries.sources import CATALOGUE, CATALOGUE_CTE, PARSED
from queries.tables import (
    CUTOFF, DAY, END, LOCAL, MILESTONES, RAW, SNAPSHOT, START, raw, read, snapshot, tape, with_tape,
)
from queries.windows import MOMENT, SPELLS, STAGES, stages

EXPECTED = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


@query(
    "Q1_schema_contract",
    """select * from (values (1, 'user_id', 'string', 'ts', 'timestamp_ntz'), (2, 'ts', 'timestamp_ntz', 'user_id', 'bigint'),
 (5, null, null, 'props', 'string')) t(place, expected, expected_type, found, found_type) where (select count(*) from events) > 0""",
)
def q1(spark, sf):
    return cx.schema_differences(read(spark, sf, "events"), EXPECTED)


@query(
    "Q2_row_count",
    """select 'events' as "table", count(*) - 1 as promised, count(*) as found from events
 union all select 'customer', max(c_custkey) + 7, count(*) from customer""",
)
def q2(spark, sf):
    events, customers = read(spark, sf, "events"), read(spark, sf, "customer")
    orders = read(spark, sf, "orders")
    manifest = events.agg((F.count(F.lit(1)) - 1).alias("events_rows")).select(
        "events_rows",
        customers.agg((F.max("c_custkey") + 7).alias("n")).scalar().alias("customer_rows"),
        orders.agg(F.count(F.lit(1)).alias("n")).scalar().alias("orders_rows"),
    )
    return cx.row_count_mismatch({"events": events, "customer": customers, "orders": orders}, manifest)


@query("Q3_blank_client", with_tape("select id, client_id from raw where client_id is null or regexp_full_match(client_id, '[\\s\\x{0B}\\x{85}\\p{Z}]*')", RAW))
def q3(spark, sf):
    return cx.blank_client(raw(spark, sf)).select("id", "client_id")


@query(
    "Q4_outside_domain",
    with_tape(
        """select source, count(*) as n_rows, min(id) as first_row from raw where source not in (select distinct source from tape) group by source""",
        RAW,
    ),
)
def q4(spark, sf):
    domain = tape(spark, sf).select("source").distinct()
    return cx.outside_domain(raw(spark, sf), "source", domain)


UNREADABLE = """unreadable as (select id, case when payload is null or trim(payload)='' then 'empty' when not json_valid(payload) then 'not json'
 when obj is null then 'not an object' else 'no type' end as reason from kinds where ptype is null)"""


@query(
    "Q5_first_bad_payload",
    with_tape("select reason, count(*) as n_rows, min(id) as first_row from unreadable group by reason", RAW, PARSED, UNREADABLE),
)
def q5(spark, sf):
    return cx.first_bad_payload(raw(spark, sf))


VIOLATIONS = """entries as (select id, ptype, unnest(json_keys(obj)) as key, obj from kinds where obj is not null),
spelled as (select id, ptype, key, json_type(obj, '$.' || key) as spelled from entries where key <> 'type'),
declared as (select s.*, c.dtype from spelled s left join catalogue c on c.type = s.ptype and c.field = s.key where s.ptype in (select type from catalogue)),
violations as (select id, 'null_payload' as kind, null as field from kinds where payload is null
 union all select id, 'unparseable', null from kinds where payload is not null and obj is null
 union all select id, 'unexpected_key', key from declared where dtype is null
 union all select id, 'type_mismatch', key from declared where dtype is not null and spelled <> 'NULL' and not
  ((dtype='str' and spelled='VARCHAR') or (dtype='bool' and spelled='BOOLEAN') or (dtype='int' and spelled in ('BIGINT','UBIGINT'))
   or (dtype='float' and spelled in ('BIGINT','UBIGINT','DOUBLE')))
 union all select k.id, 'missing_required', c.field from kinds k join catalogue c on c.type = k.ptype and c.required
  where coalesce(json_type(k.obj, '$.' || c.field), 'NULL') = 'NULL')"""


def violations(spark, sf):
    return cx.payload_violations(raw(spark, sf), rx.catalogue_table(spark, CATALOGUE))


@query(
    "Q6_payload_violations",
    with_tape("select kind, field, count(*) as n from violations group by kind, field", RAW, PARSED, CATALOGUE_CTE, VIOLATIONS),
)
def q6(spark, sf):
    return cx.violation_counts(violations(spark, sf))


@query(
    "Q6_violation_samples",
    with_tape(
        "select id, kind, field from violations qualify row_number() over (partition by kind order by id, field nulls first) <= 20",
        RAW, PARSED, CATALOGUE_CTE, VIOLATIONS,
    ),
)
def q6_samples(spark, sf):
    return cx.violation_samples(violations(spark, sf))


@query(
    "Q7_strict_time",
    with_tape(
        r"""select id, event_time from raw where not coalesce(regexp_full_match(event_time, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?([+-]\d{2}:\d{2}|Z)')
 and try_cast(left(event_time, 10) as date) is not null, false)""",
        RAW,
    ),
)
def q7(spark, sf):
    return cx.unreadable_times(raw(spark, sf))


@query(
    "Q8_duplicate_snapshot",
    "select o_custkey, count(*) as n_rows from orders group by o_custkey having count(*) > 1",
)
def q8(spark, sf):
    return cx.duplicate_clients(read(spark, sf, "orders"), "o_custkey")


# Milestones in the declared order; the source id of the first registration is taken away and a job is
# recorded late for some clients, so that every check has something to find.
BAD_MOMENT = "c_custkey % 50 = 1"


@query(
    "Q9_milestone_problems",
    f"""with {SNAPSHOT}, x as (select *, app_registered is not null and app_registered < bank_registered as swapped,
 (first_loan_opened is not null and app_registered is not null and first_loan_opened < app_registered) or (first_loan_opened < bank_registered) as late from snap)
 select client, 'moment' as problem from x where {BAD_MOMENT}
 union all select client, 'order' from x where coalesce(swapped, false) or coalesce(late, false)
 union all select client, 'source' from x where first_loan_opened is not null
 union all select client, 'future' from x where {BAD_MOMENT} and (app_registered >= {CUTOFF} or first_loan_opened >= {CUTOFF} or bank_registered >= {CUTOFF})""",
)
def q9(spark, sf):
    rows = snapshot(spark, sf).withColumn("as_of", F.expr(f"case when {BAD_MOMENT} then {CUTOFF} else as_of end"))
    return cx.milestone_problems(rows, END, MILESTONES, MILESTONES[:2])


@query(
    "Q10_employment_problems",
    f"""with {SNAPSHOT} select client, 'future' as problem from snap where job_recorded >= {CUTOFF}
 union all select client, 'start_after_record' from snap where job_start_day > (job_recorded + {LOCAL}) // {DAY}""",
)
def q10(spark, sf):
    rows = snapshot(spark, sf).withColumns(
        {
            "as_of": F.lit(CUTOFF),
            "employment": F.array(F.struct(F.col("job_start_day").alias("start_day"), F.col("job_recorded").alias("recorded"))),
        }
    )
    return cx.employment_problems(rows, local_day)


@query(
    "Q11_split_clients",
    with_tape(
        """select client, count(*) as pieces from (select client, lag(client) over (order by id) as before from
 (select u % 20 as g, 'g' || cast(u % 20 as string) as client, id from tape)) where before is null or before <> client group by client having count(*) > 1"""
    ),
)
def q11(spark, sf):
    return cx.split_clients(tape(spark, sf).select("id", F.concat(F.lit("g"), (F.col("u") % 20).cast("string")).alias("client")))


@query(
    "Q12_missing_envelope",
    with_tape("select id, 'client_id' as field from raw where client_id is null union all select id, 'payload' from raw where payload is null", RAW),
)
def q12(spark, sf):
    return cx.missing_envelope(raw(spark, sf), ["client_id", "event_time", "source", "payload"])


# Milestone links: the registration event is the first event of a client; its moment is shifted by rule.
LINKS = f"""src as (select client, 'app_registered' as kind, 'app_registered-' || client as source_id, id,
 case when u % 3 = 0 then t else (select app_registered from snap where snap.client = f.client) end as t from
 (select *, row_number() over (partition by client order by t, id) as rn from tape) f where rn = 1),
wanted as (select client, 'app_registered' as kind, 'app_registered-' || client as source_id, app_registered as moment from snap where app_registered is not null),
pairs as (select w.*, s.id, s.t from wanted w left join src s using (client, kind, source_id))"""


@query(
    "Q13_milestone_links",
    with_tape(
        f"""select client, kind, source_id, case when id is null then 'missing' else 'moved' end as problem from pairs
 where (id is null and moment >= {START}) or (id is not null and t <> moment)""",
        SNAPSHOT, LINKS,
    ),
)
def q13(spark, sf):
    snap = snapshot(spark, sf)
    only = F.filter("lifelong", lambda x: x["type"] == "app_registered")
    snap = snap.withColumn("lifelong", only)
    first = tape(spark, sf).groupBy("client", "u").agg(F.min(F.struct("t", "id")).alias("f"))
    joined = first.join(snap.select("client", "app_registered"), "client", "left")
    events = joined.select(
        "client",
        F.lit("app_registered").alias("kind"),
        F.concat(F.lit("app_registered-"), "client").alias("source_id"),
        F.col("f.id").alias("id"),
        F.when(F.col("u") % 3 == 0, F.col("f.t")).otherwise(F.col("app_registered")).alias("t"),
    )
    return cx.milestone_links(snap, events, START)


@query(
    "Q14_strangers",
    with_tape("select distinct client from tape where client not in (select client from snap where region <> 'BUILDING')", SNAPSHOT),
)
def q14(spark, sf):
    return cx.strangers(tape(spark, sf), snapshot(spark, sf).filter("region <> 'BUILDING'"))


@query(
    "Q15_group_overlap",
    """select o_custkey, count(distinct o_orderstatus) as n_groups, count(*) as n_rows from orders group by o_custkey
 having count(distinct o_orderstatus) > 1 or count(*) > 1""",
)
def q15(spark, sf):
    return cx.overlapping_groups(read(spark, sf, "orders"), "o_custkey", "o_orderstatus")


SIGN = "case when type in ('salary_credit','cash_deposit','transfer_in') then 1 else -1 end"


@query(
    "Q16_balance_chain",
    with_tape(
        f"""select id, account_id, before, balance_after, (before + sign * coalesce(amount, 0)) as expected from
 (select *, {SIGN} as sign, lag(balance_after) over (partition by account_id order by t, id) as before from tape
 where account_id is not null and balance_after is not null and coalesce(status, 'approved') = 'approved')
 where before is not null and balance_after <> before + sign * coalesce(amount, 0)"""
    ),
)
def q16(spark, sf):
    rows = tape(spark, sf).filter("coalesce(status, 'approved') = 'approved'").withColumn("sign", F.expr(SIGN))
    return cx.broken_balances(rows)


LEGS = "legs as (select *, client || '-' || cast(k % 10 as string) as transfer_id from tape where type in ('transfer_out','transfer_in'))"


@query(
    "Q17_two_legged_transfers",
    with_tape(
        """select transfer_id, count(*) filter (where type='transfer_out') as n_out, count(*) filter (where type='transfer_in') as n_in,
 (sum(amount) filter (where type='transfer_out'))::bigint as sum_out, (sum(amount) filter (where type='transfer_in'))::bigint as sum_in
 from legs group by transfer_id having n_out <> 1 or n_in <> 1 or sum_out <> sum_in""",
        LEGS,
    ),
)
def q17(spark, sf):
    rows = tape(spark, sf).withColumn("transfer_id", F.concat("client", F.lit("-"), (F.col("k") % 10).cast("string")))
    return cx.unpaired_transfers(rows, "transfer_out", "transfer_in")


@query(
    "Q18_used_after_close",
    with_tape(
        """select u.id, u.contract_id, u.t, c.closed_at from tape u join (select contract_id, min(t) as closed_at from tape where type='product_closed' group by 1) c
 on c.contract_id = u.contract_id where u.type in ('loan_payment','installment_missed') and u.t >= c.closed_at"""
    ),
)
def q18(spark, sf):
    rows = tape(spark, sf)
    return cx.used_after_close(
        rows.filter(kind("loan_payment", "installment_missed")), rows.filter(kind("product_closed")), "contract_id"
    )


FIELDS = ("client", "t", "type", "amount", "status")


def _line(alias=""):
    dot = f"{alias}." if alias else ""
    return "concat_ws(chr(31), " + ", ".join(f"coalesce(cast({dot}{f} as varchar), '\\N')" for f in FIELDS) + ")"


@query(
    "Q19_client_digest",
    with_tape(
        """select l0.client, n_rows, digest from (select client, count(*) as n_rows from tape group by client) l0 join (select client, sha256(string_agg(h, chr(30) order by n)) as digest from l3 group by client) using (client)""",
        f"l0h as (select client, row_number() over (partition by client order by t, id) - 1 as n, sha256({_line()}) as h from tape)",
        "l1 as (select client, n // 8 as n, sha256(string_agg(h, chr(30) order by n)) as h from l0h group by client, n // 8)",
        "l2 as (select client, n // 8 as n, sha256(string_agg(h, chr(30) order by n)) as h from l1 group by client, n // 8)",
        "l3 as (select client, n // 8 as n, sha256(string_agg(h, chr(30) order by n)) as h from l2 group by client, n // 8)",
    ),
)
def q19(spark, sf):
    return cx.client_digests(tape(spark, sf), FIELDS, fan_out=8)


CHANGED = "changed as (select id, client, t, type, case when k = 50 and u % 4 = 1 then amount + 1 else amount end as amount, status from tape where not (k = 51 and u % 4 = 2))"


def changed(spark, sf):
    return tape(spark, sf).filter("not (k = 51 and u % 4 = 2)").selectExpr(
        "id", "client", "t", "type", "case when k = 50 and u % 4 = 1 then amount + 1 else amount end as amount", "status"
    )


COMPARED = f"""a as (select client, row_number() over (partition by client order by t, id) - 1 as n, t, {_line()} as l from tape where t < {CUTOFF}),
b as (select client, row_number() over (partition by client order by t, id) - 1 as n, t, {_line()} as l from changed where t < {CUTOFF}),
both_sides as (select coalesce(a.client, b.client) as client, coalesce(a.n, b.n) as n, coalesce(a.t, b.t) as t, a.l as al, b.l as bl
 from a full outer join b on a.client = b.client and a.n = b.n),
diverged as (select client, count(al) as left_rows, count(bl) as right_rows, min(n) filter (where al is distinct from bl) as first_difference,
 arg_min(t, n) filter (where al is distinct from bl) as moment from both_sides group by client having first_difference is not null)"""


def compared(spark, sf):
    past = F.col("t") < CUTOFF
    return cx.compare_exports(tape(spark, sf).filter(past), changed(spark, sf).filter(past), FIELDS)


@query("Q20_compare_exports", with_tape("select * from diverged", CHANGED, COMPARED))
def q20(spark, sf):
    return compared(spark, sf)


@query(
    "Q20_diverged_share",
    with_tape(
        "select *, diverged <= 0.05 * clients as within from (select count(*) as diverged, (select count(distinct client) from tape) as clients from diverged)",
        CHANGED, COMPARED,
    ),
)
def q20_share(spark, sf):
    return cx.diverged_share(compared(spark, sf), tape(spark, sf), 0.05)


@query(
    "Q21_fingerprint",
    with_tape(f"select count(*) as n_rows, cast(sum(cast('0x' || substr(sha256({_line()}), 1, 13) as bigint)) as varchar) as checksum from tape"),
)
def q21(spark, sf):
    return cx.fingerprint(tape(spark, sf), FIELDS)


@query(
    "Q21_lineage",
    with_tape(
        f"""select name, found, expected from (select 'rows' as name, cast(count(*) as varchar) as found, cast(count(*) as varchar) as expected from tape
 union all select 'cutoff', cast(max(t) as varchar), '{CUTOFF}' from tape union all select 'types', cast(count(distinct type) as varchar), null from tape)
 where found is distinct from expected"""
    ),
)
def q21_lineage(spark, sf):
    facts = tape(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.max("t").alias("last"), F.count_distinct("type").alias("types")
    )
    have = facts.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("name"), F.col("n").cast("string").alias("value")),
                F.struct(F.lit("cutoff").alias("name"), F.col("last").cast("string").alias("value")),
                F.struct(F.lit("types").alias("name"), F.col("types").cast("string").alias("value")),
            )
        ).alias("x")
    ).select("x.*")
    want = facts.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("name"), F.col("n").cast("string").alias("value")),
                F.struct(F.lit("cutoff").alias("name"), F.lit(str(CUTOFF)).alias("value")),
            )
        ).alias("x")
    ).select("x.*")
    return cx.lineage_problems(have, want)


ALLOWED = ("amount", "channel", "status", "colour", "type")
INTERNAL = ("k", "type")


@query(
    "Q22_field_coverage",
    with_tape(
        f"""select coalesce(f.field, n.field) as field, f.field is not null as known, coalesce(n_allowed, 0)::bigint as n_allowed, coalesce(n_internal, 0)::bigint as n_internal
 from (select distinct key as field from entries) f full outer join (select field, sum(a) as n_allowed, sum(i) as n_internal from
 (values {", ".join(f"('{x}', 1, 0)" for x in ALLOWED)}, {", ".join(f"('{x}', 0, 1)" for x in INTERNAL)}) t(field, a, i) group by field) n on n.field = f.field
 where f.field is null or coalesce(n_allowed, 0) + coalesce(n_internal, 0) <> 1""",
        RAW, PARSED, "entries as (select unnest(json_keys(obj)) as key from kinds where obj is not null)",
    ),
)
def q22(spark, sf):
    fields = raw(spark, sf).select(F.explode(F.map_keys(rx.payload_map(F.col("payload")))).alias("field"))
    allowed = spark.createDataFrame([(x,) for x in ALLOWED], "field string")
    internal = spark.createDataFrame([(x,) for x in INTERNAL], "field string")
    return cx.field_coverage(fields, allowed, internal)


@query(
    "Q23_mixed_value_kinds",
    with_tape(
        """select key, string_agg(kind, ',' order by kind) as kinds, count(*) as n_kinds from (select distinct key,
 case json_type(obj, '$.' || key) when 'UBIGINT' then 'BIGINT' when 'VARCHAR' then 'STRING' else json_type(obj, '$.' || key) end as kind
 from (select obj, unnest(json_keys(obj)) as key from kinds where obj is not null) where json_type(obj, '$.' || key) <> 'NULL') group by key having count(*) > 1""",
        RAW, PARSED,
    ),
)
def q23(spark, sf):
    entries = raw(spark, sf).select(F.explode(rx.payload_map(F.col("payload"))).alias("key", "value"))
    kinds = entries.select("key", F.schema_of_variant("value").alias("vtype")).filter("vtype <> 'VOID'")
    return cx.mixed_kinds(kinds)


KNOWN = f"""known as (select client, id, started_at, stage, case when next_stage is not null and ended_at <= {MOMENT} then next_stage end as next_stage from spelled where started_at <= {MOMENT}),
cut as (select client, id, started_at, stage, lead(stage) over (partition by client order by started_at, id) as next_stage from stages where started_at <= {MOMENT})"""


@query(
    "Q27_no_leak",
    f"""with {STAGES}, {SPELLS}, {KNOWN} select count(*) as differing, (select count(*) from cut) as compared
 from ((select * from known except all select * from cut) union all (select * from cut except all select * from known))""",
)
def q27(spark, sf):
    rows = stages(spark, sf)
    known = wx.spells(rows, END).filter(F.col("started_at") <= MOMENT).select(
        "client", "id", "started_at", "stage",
        F.when(F.col("next_stage").isNotNull() & (F.col("ended_at") <= MOMENT), F.col("next_stage")).alias("next_stage"),
    )
    cut = wx.spells(rows.filter(F.col("started_at") <= MOMENT), MOMENT).select(
        "client", "id", "started_at", "stage", "next_stage"
    )
    n = cut.agg(F.count(F.lit(1)).alias("n")).scalar()
    differing = cx.not_reproduced(known, cut).agg(F.count(F.lit(1)).alias("differing"))
    return differing.select("differing", n.alias("compared"))


@query(
    "Q29_payload_key_profile",
    with_tape(
        """select ptype as type, source, key, count(*) as n from (select ptype, source, obj, unnest(json_keys(obj)) as key from kinds where obj is not null)
 where json_type(obj, '$.' || key) <> 'NULL' group by 1, 2, 3""",
        RAW, PARSED,
    ),
)
def q29(spark, sf):
    return cx.payload_key_profile(raw(spark, sf))
