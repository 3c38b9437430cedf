"""The test tables read as a bank's tape.

`events` is the tape: its user is the client, its type and the number in the
JSON `props` choose the operation and its fields, and its 30 days are stretched
to a year so that windows of 7 to 90 days mean something. `customer` is the
snapshot, `orders` the contracts. Field rules are texts that both Spark and the
checking database understand; the operators under test are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotape.plans.shared import written

DAY = 86_400_000_000
HOUR = 3_600_000_000
START = 1_704_067_200_000_000          # 2024-01-01 00:00 UTC
LOCAL = 5 * HOUR                        # fixed local offset
CUTOFF = START + 290 * DAY              # T of the feature tables
END = START + 360 * DAY                 # window end, snapshot moment
HORIZON = 60
#: Rows of a task that derives the tape.
TAPE_ROWS = 250_000

# Derived fields: name -> expression over e (event type), k, v (value), u (user), t, id.
TYPE = """case
 when e='view' then case k%4 when 1 then 'app_screen' when 2 then 'communication_sent' else 'app_operation' end
 when e='click' then case k%5 when 0 then 'banner_clicked' when 1 then 'app_operation' when 2 then 'profile_change'
   when 3 then 'case_opened' else 'application_submitted' end
 when e='purchase' then case k%5 when 2 then 'transfer_out' when 3 then 'cash_withdrawal' when 4 then 'bill_payment'
   else 'purchase' end
 when e='error' then case k%5 when 0 then 'app_operation' when 1 then 'purchase' when 2 then 'fraud_alert'
   when 3 then 'card_blocked' else 'installment_missed' end
 else case k%6 when 0 then 'product_opened' when 1 then 'salary_credit' when 2 then 'cash_deposit'
   when 3 then 'transfer_in' when 4 then 'product_closed' else 'loan_payment' end end"""

FIELDS = {
    "source": """case when type in ('app_operation','app_screen','banner_clicked') then 'app'
 when type in ('loan_payment','installment_missed') then 'loans'
 when type in ('communication_sent','case_opened') then 'crm'
 when type in ('profile_change','application_submitted','product_opened','product_closed') then 'registry'
 else 'ledger' end""",
    "operation": """case when type='app_operation' then case when e='error' then 'login' when e='click' then 'limit_change'
 when k%4=0 then 'login' else 'biometry_login' end end""",
    "status": """case when type='app_operation' then case when e='error' then 'failed' else 'success' end
 when type in ('purchase','transfer_out','cash_withdrawal') then case when e='error' then 'declined' else 'approved' end end""",
    "reason": """case when type='purchase' then case when k%10=1 then 'subscription' when k%20=5 then 'insurance_premium' else 'purchase' end
 when type='transfer_out' then case when k%3=0 then 'own_transfer' else 'transfer' end
 when type='cash_deposit' then case when k%12=2 then 'payment_topup' else 'deposit' end
 when type='transfer_in' then 'transfer'
 when type='card_blocked' then case when k%2=1 then 'fraud_suspicion' else 'client_freeze' end
 when type='product_opened' then case when k%12=0 then 'application_approved' else 'bank_offer' end
 when type='product_closed' then case when k%12=4 then 'early_closure' else 'expired' end end""",
    "channel": """case when type='communication_sent' then case k%16 when 2 then 'push' when 6 then 'sms' when 10 then 'call' else 'email' end
 when type='purchase' then case when k%3=0 then 'ecom' else 'pos' end
 when type='bill_payment' then case when k%10=4 then 'system' else 'app' end
 when type='loan_payment' then case when k%12=5 then 'system' else 'app' end
 when type='transfer_out' then 'app' end""",
    "amount": """case when type in ('purchase','transfer_out','cash_withdrawal','bill_payment','salary_credit','cash_deposit',
 'transfer_in','loan_payment') then cast(round(v*100) as bigint) end""",
    "mcc": "case when type='purchase' then cast(5000+k%12 as string) end",
    "merchant_category": "case when type='purchase' and k%13<>6 then 'Category ' || cast(k%8 as string) end",
    "merchant_name": "case when type='purchase' then 'Merchant ' || cast(k%25 as string) end",
    "merchant_country": "case when type='purchase' and k%7<>3 then case when k%9=0 then 'TR' else 'KZ' end end",
    "merchant_city": "case when type='purchase' then 'City ' || cast(k%6 as string) end",
    "is_online": "case when type='purchase' then k%3=0 end",
    "original_currency": "case when type='purchase' and k%4=1 then case when k%9=0 then 'TRY' else 'KZT' end end",
    "counterparty": """case when type='transfer_out' then case when k%8=2 then 'Own account' else 'Payee ' || cast(k%15 as string) end
 when type='transfer_in' then case when k%4=1 then 'Own account' else 'Payer ' || cast(k%5 as string) end end""",
    "account_id": """case when type in ('purchase','transfer_out','cash_withdrawal','bill_payment','salary_credit','cash_deposit',
 'transfer_in') then 'a' || cast(u as string) || '-' || cast(k%3 as string) end""",
    "balance_after": """case when type in ('purchase','transfer_out','cash_withdrawal','bill_payment','salary_credit','cash_deposit',
 'transfer_in') and k%11<>0 then cast(round(v*300) as bigint) - 4000 end""",
    "contract_id": """case when type in ('product_opened','product_closed','loan_payment','installment_missed','card_blocked')
 then 'd' || cast(u as string) || '-' || cast(k%4 as string) end""",
    "card_id": "case when type in ('purchase','card_blocked') then 'card' || cast(u as string) || '-' || cast(k%2 as string) end",
    "product_id": "case when type in ('product_opened','product_closed','application_submitted') then 'P' || cast(k%8 as string) end",
    "session_id": "case when type in ('app_operation','app_screen') then 's' || cast(k%20 as string) end",
    "device_new": "case when type='app_operation' and operation in ('login','biometry_login') then k%10=0 end",
    "template": "case when type='communication_sent' then case when k%8=2 then 'WB_' else 'INFO_' end || cast(k%3 as string) end",
    "delivered": "case when type='communication_sent' then k%5<>1 end",
    "field_name": """case when type='profile_change' then case k%15 when 2 then 'region' when 7 then 'city' else
 case when k%2=0 then 'income_type' else 'declared_income' end end end""",
    "old_value": """case when type='profile_change' and k%9<>0 then case when field_name='declared_income'
 then cast(100000+k*1000 as string) else 'old ' || field_name || ' ' || cast(k%5 as string) end end""",
    "new_value": """case when type='profile_change' then case when field_name='declared_income'
 then cast(100000+k*1100 as string) else 'new ' || field_name || ' ' || cast(k%5 as string) end end""",
    "change_source": "case when type='profile_change' then case when k%4=2 then 'bank' else 'client' end end",
    "days_past_due": "case when type in ('loan_payment','installment_missed') then cast(k%40 as bigint) end",
    "decline_reason": "case when status='declined' then case when k%2=0 then 'insufficient_funds' else 'limit' end end",
    "note": """case when type='case_opened' then '  Case   No ' || cast(k%13 as string) || ' ' || upper(e) || '  '
 when type='communication_sent' then 'Dear client,  offer ' || template end""",
}

_DEPENDENT = ("device_new", "old_value", "new_value", "decline_reason", "note")
_FIRST = [f for f in FIELDS if f not in _DEPENDENT]


def _layered(base: str) -> str:
    first = ",\n ".join(f"{FIELDS[f]} as {f}" for f in _FIRST)
    second = ",\n ".join(f"{FIELDS[f]} as {f}" for f in _DEPENDENT)
    return (
        f"select *, {second} from (select *, {first} from (select *, {TYPE} as type from ({base}) b0) b1) b2"
    )


_DUCK_BASE = f"""select event_id as id, user_id as u, 'c' || cast(user_id as string) as client,
 {START} + (epoch_us(ts) - {START}) * 12 as t, event_type as e, value as v,
 cast(props->>'$.k' as bigint) as k from events"""

TAPE = f"tape as ({_layered(_DUCK_BASE)})"

# The client snapshot, with dated milestones and employment records flattened for SQL.
SNAPSHOT_FIELDS = {
    "client": "'c' || cast(c_custkey as string)",
    "gender": "case when c_custkey%2=0 then 'F' else 'M' end",
    "region": "c_mktsegment",
    "city": "'City ' || cast(c_custkey%6 as string)",
    "income_type": "case c_custkey%3 when 0 then 'salary' when 1 then 'pension' else 'business' end",
    "declared_income": "cast(100000 + round(c_acctbal) as bigint)",
    "birth_day": "cast(-9000 + c_custkey*37%14000 as bigint)",
    "app_registered": f"case when c_custkey%7<>3 then {START} + (c_custkey*11%330)*{DAY} + 3*{HOUR} end",
    "bank_registered": f"{START} - (c_custkey%400)*{DAY}",
    "first_loan_opened": f"case when c_custkey%3=1 then {START} + (c_custkey*17%350)*{DAY} end",
    "job_start_day": "cast(15000 + c_custkey*13%4500 as bigint)",
    "job_recorded": f"{START} + (c_custkey*7%340)*{DAY}",
    "family_status": "case c_custkey%4 when 0 then 'married' when 1 then 'single' when 2 then 'divorced' end",
    "education": "case when c_custkey%5<3 then 'higher' else 'secondary' end",
    "housing_type": "case when c_custkey%6<>4 then case when c_custkey%2=0 then 'own' else 'rent' end end",
    "industry": "'Industry ' || cast(c_custkey%9 as string)",
    "income_day": "cast(1 + c_custkey%28 as bigint)",
    "children": "cast(c_custkey%4 as bigint)",
    "first_card_activated": f"case when c_custkey%5<>2 then {START} + (c_custkey*19%345)*{DAY} end",
    "first_deposit_opened": f"case when c_custkey%4=3 then {START} + (c_custkey*23%340)*{DAY} end",
}
_snapshot_select = ", ".join(f"{x} as {n}" for n, x in SNAPSHOT_FIELDS.items())
SNAPSHOT = f"snap as (select c_custkey, c_nationkey, {_snapshot_select} from customer)"

MILESTONES = ("bank_registered", "app_registered", "first_loan_opened")
ALL_MILESTONES = ("bank_registered", "app_registered", "first_card_activated", "first_loan_opened", "first_deposit_opened")

# Product families; a premium product is a debit card of the top tier.
FAMILY = """case product_id when 'P0' then 'debit_card' when 'P1' then 'debit_card' when 'P2' then 'credit_card'
 when 'P3' then 'loan' when 'P4' then 'deposit' when 'P5' then 'service' when 'P6' then 'debit_card' end"""


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tape(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """The derived tape: id, client, t (microseconds), type and its fields; of a stream when one is given."""
    return _tape(spark, sf, events)


def stored_tape(spark: SparkSession, sf: str) -> DataFrame:
    """The tape, derived and written once, for a query that reads it several times: reads take the columns they need."""
    return written(tape(spark, sf), "tape")


def _tape(spark: SparkSession, sf: str, events: DataFrame | None) -> DataFrame:
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    if events is None:
        # Files tell little of the rows: a file may be one row group, and a row makes many values. The number of
        # tasks grows with the rows, so that what a task holds does not.
        events = read(spark, sf, "events")
        tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // TAPE_ROWS))
        if len(events.inputFiles()) < tasks:
            events = events.repartition(tasks, "event_id")
    base = events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("u"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"),
        (F.lit(START) + (moment - START) * 12).alias("t"),
        F.col("event_type").alias("e"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    first = base.selectExpr("*", f"{TYPE} as type").selectExpr("*", *[f"{FIELDS[f]} as {f}" for f in _FIRST])
    typed = first.selectExpr("*", *[f"{FIELDS[f]} as {f}" for f in _DEPENDENT])
    # The field rules stand for a typed table on disk: `inline` keeps the optimizer
    # from copying them into every predicate of the query that reads the tape.
    return typed.select(F.inline(F.array(F.struct(*typed.columns))))


def snapshot(spark: SparkSession, sf: str, milestones: tuple[str, ...] = MILESTONES) -> DataFrame:
    """One row per client: attributes, dated milestones and employment as arrays of structs."""
    flat = read(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey", *[f"{x} as {n}" for n, x in SNAPSHOT_FIELDS.items()]
    )
    items = F.array(
        *[
            F.struct(F.lit(m).alias("type"), F.col(m).alias("t"), F.concat(F.lit(f"{m}-"), "client").alias("source_id"))
            for m in milestones
        ]
    )
    return flat.select(
        "*",
        F.filter(items, lambda x: x["t"].isNotNull()).alias("lifelong"),
        F.array(F.struct(F.col("job_start_day").alias("start_day"), F.col("job_recorded").alias("recorded"))).alias(
            "employment"
        ),
        F.lit(END).alias("as_of"),
    )


def families(spark: SparkSession, sf: str) -> DataFrame:
    """Product dimension: every product id of the tape with its family (null when unknown)."""
    return tape(spark, sf).filter("product_id is not null").select("product_id").distinct().selectExpr(
        "product_id", f"{FAMILY} as family", "product_id = 'P6' as premium"
    )


FAMILIES = f"families as (select product_id, {FAMILY} as family, product_id = 'P6' as premium from (select distinct product_id from tape where product_id is not null) p)"

# The raw export: four text columns. Some payloads are broken on purpose, by rule.
RAW_BAD = {
    "null": "k=91",
    "unparseable": "k=92",
    "not_object": "k=93",
    "no_type": "k=94",
}
_payload = """case when k=91 then null when k=92 then '{"type":"purchase","amo' when k=93 then '[1,2]' when k=94 then '{"amount":5}'
 else '{"type":"' || type || '"'
 || case when amount is not null then ',"amount":' || case when k=17 then '"' || cast(amount as string) || '"' when k=18 then 'true'
   when k=19 then 'null' else cast(amount as string) end else '' end
 || case when channel is not null then ',"channel":"' || channel || '"' else '' end
 || case when status is not null then ',"status":"' || status || '"' else '' end
 || case when is_online is not null then ',"is_online":' || case when is_online then 'true' else 'false' end else '' end
 || case when k=20 then ',"surprise":1' else '' end
 || ',"k":' || cast(k as string) || '}' end"""
_duck_time = "strftime(make_timestamp(t + 18000000000), '%Y-%m-%dT%H:%M:%S.%g')"
_bad_time = """case when k=95 then left({x}, 19) when k=96 then '2024-02-30T10:00:00+05:00' when k=97 then 'yesterday'
 else {x} || '+05:00' end"""
RAW = f"""raw as (select id, case when k=98 then chr(9) || chr(160) when k=99 then null else client end as client_id,
 {_bad_time.format(x=_duck_time)} as event_time,
 case when k=90 then 'unknown_system' else source end as source, {_payload} as payload from tape)"""


def raw(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """The raw export of the tape: row id, client_id, event_time, source, payload as text."""
    text = "date_format(timestamp_micros(t + 18000000000), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")"
    return tape(spark, sf, events).selectExpr(
        "id",
        "case when k=98 then chr(9) || chr(160) when k=99 then null else client end as client_id",
        f"{_bad_time.format(x=text)} as event_time",
        "case when k=90 then 'unknown_system' else source end as source",
        f"{_payload} as payload",
    )


def with_tape(body: str, *ctes: str) -> str:
    """SQL over the derived tape and any further named tables."""
    return "with " + ",\n".join([TAPE, *ctes]) + "\n" + body
