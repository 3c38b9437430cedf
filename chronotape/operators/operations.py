"""Features of every scored operation, from what the client did strictly before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.functions.clock import DAY, HOUR, local_timestamp
from chronotape.operators import predicates as p
from chronotape.operators.features import share
from chronotape.operators.predicates import kind, sure
from chronotape.operators.profile import age_at
from chronotape.plans.split import Measure, Split, plan_split, rolling_sums, running

WINDOWS = {"1h": HOUR, "1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY, "90d": 90 * DAY}
# log1p(amount) is summed as whole millionths, so that equal histories have a spread of exactly zero.
LOG_SCALE = 1_000_000
NOVELTY = {"mcc": "mcc", "merchant": "merchant_name", "country": "merchant_country", "counterparty": "counterparty"}
PROFILE_FIELDS = ("region", "city", "income_type", "declared_income")
ABSENT = "NA"


def log_units(amount: Column) -> Column:
    return F.round(F.log1p(F.coalesce(amount, F.lit(0)).cast("double")) * LOG_SCALE).cast("bigint")


def history(tape: DataFrame, split: Split | None = None) -> DataFrame:
    """Rolling counts and sums, last moments and values before each row of the tape."""
    split = split or plan_split(tape, ["client"], "t")
    txn = p.is_operation()
    one = lambda mask: F.when(mask, F.lit(1).cast("bigint"))
    login = p.is_login()
    new_device = login & sure(F.col("device_new"))
    logs = F.when(txn, log_units(F.col("amount")))
    values = {
        "txn_count": one(txn),
        "txn_sum": F.when(txn, F.col("amount")),
        "log": logs,
        "log_square": logs.cast("decimal(19,0)") * logs.cast("decimal(19,0)"),
        "declined_count": one(txn & sure(F.col("status") == "declined")),
        "online_count": one(txn & sure(F.col("is_online"))),
        "foreign_count": one(txn & p.is_foreign()),
        "login_count": one(login),
        "login_failed": one(login & sure(F.col("status") == "failed")),
        "new_device_login": one(new_device),
        "fraud_alert": one(kind("fraud_alert")),
        "fraud_block": one(kind("card_blocked") & sure(F.col("reason") == "fraud_suspicion")),
        "income_sum": F.when(kind(*p.INCOME_TYPES), F.col("amount")),
    }
    pairs = [("txn_count", w) for w in WINDOWS] + [("txn_sum", w) for w in WINDOWS]
    pairs += [(v, w) for v in ("declined_count", "login_count", "login_failed", "new_device_login") for w in ("1h", "1d")]
    pairs += [("online_count", "1d"), ("foreign_count", "1d"), ("foreign_count", "90d")]
    pairs += [("log", "90d"), ("log_square", "90d"), ("income_sum", "90d")]
    pairs += [("fraud_alert", "1d"), ("fraud_alert", "30d"), ("fraud_block", "30d")]
    rolled = rolling_sums(tape, split, WINDOWS, values, pairs)
    known = kind(*p.EVERYDAY_TYPES) & F.col("balance_after").isNotNull()
    return running(
        rolled,
        split,
        [
            Measure("txn_at", "max", F.when(txn, F.col("t"))),
            Measure("login_at", "max", F.when(login, F.col("t"))),
            Measure("new_device_at", "max", F.when(new_device, F.col("t"))),
            Measure("amount_max", "max", F.when(txn, F.coalesce(F.col("amount"), F.lit(0)))),
            Measure("balance", "max", F.when(known, F.struct("t", "id", "balance_after"))),
        ],
    )


def hours_between(now: Column, then: Column) -> Column:
    return (now - then) / F.lit(float(HOUR))


def novelty(tape: DataFrame, clients: Split | None = None) -> DataFrame:
    """Per operation: hours since the client last used the same code, merchant, country or payee.

    One row per (operation, field) is enough: the four fields are stacked and
    share a single pass over (client, field, value). `clients` is a split of the tape by client.
    """
    purchase, outgoing = p.is_purchase(), kind("transfer_out", "p2p_out")
    past = {"mcc": purchase, "merchant": purchase, "country": purchase, "counterparty": outgoing}
    operation = p.is_operation()
    marks = F.array(
        *[
            F.when(
                F.col(field).isNotNull() & (past[name] | operation),
                F.struct(F.lit(name).alias("name"), F.col(field).alias("value"), past[name].alias("past")),
            )
            for name, field in NOVELTY.items()
        ]
    )
    stacked = tape.select(
        "client", "id", "t", operation.alias("scored"), F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")
    ).select("client", "id", "t", "scored", "m.*")
    split = plan_split(stacked, ["client", "name", "value"], "t", like=clients)
    seen = running(stacked, split, [Measure("before", "max", F.when(F.col("past"), F.col("t")))])
    hours = hours_between(F.col("t"), F.col("before"))
    return (
        seen.filter("scored")
        .groupBy("id")
        .agg(
            *[F.max(F.when(F.col("name") == n, hours)).alias(f"{n}_hours_since_prev") for n in NOVELTY],
            *[
                F.coalesce(F.max((F.col("name") == n) & F.col("before").isNull()), F.lit(False))
                .cast("int")
                .alias(f"{n}_is_new")
                for n in NOVELTY
            ],
        )
    )


def profile_at_rows(tape: DataFrame, fields=PROFILE_FIELDS, clients: Split | None = None) -> DataFrame:
    """Old value of the first change at or after each row, per field: `<f>_hit`, `<f>_old`."""
    turned = tape.withColumn("_neg", -F.col("t"))
    split = plan_split(turned, ["client"], "_neg", like=clients)
    measures = [
        Measure(
            f"_{f}",
            "max",
            F.when(
                kind("profile_change") & sure(F.col("field_name") == f),
                F.struct(F.col("_neg"), (-F.col("id")).alias("o"), "old_value"),
            ),
        )
        for f in fields
    ]
    found = running(turned, split, measures, through=True)
    return found.select(
        *tape.columns,
        *[F.col(f"_{f}").isNotNull().alias(f"{f}_hit") for f in fields],
        *[F.col(f"_{f}.old_value").alias(f"{f}_old") for f in fields],
    )


def row_features() -> dict[str, Column]:
    """Features of the row itself, without its outcome."""
    local = local_timestamp(F.col("t"))
    text = lambda name: F.coalesce(F.col(name), F.lit(ABSENT))
    amount = F.col("amount")
    return {
        "is_transfer": kind("transfer_out").cast("int"),
        "own_transfer": sure(F.col("reason") == "own_transfer").cast("int"),
        "channel": text("channel"),
        "is_online": sure(F.col("is_online")).cast("int"),
        "amount": amount,
        "log_amount": F.round(F.log1p(amount.cast("double")), 9),
        "foreign_currency": sure(F.col("original_currency") != p.HOME_CURRENCY).cast("int"),
        "merchant_country": text("merchant_country"),
        "is_foreign": p.is_foreign().cast("int"),
        "mcc": text("mcc"),
        "merchant_category": text("merchant_category"),
        "merchant_name": text("merchant_name"),
        "hour": F.hour(local),
        "weekday": F.weekday(local),
        "day_of_month": F.dayofmonth(local),
    }


def history_features() -> dict[str, Column]:
    found: dict[str, Column] = {"txn_hours_since_prev": hours_between(F.col("t"), F.col("txn_at"))}
    for value in ("txn_count", "txn_sum"):
        for w in WINDOWS:
            found[f"{value}_{w}"] = F.col(f"{value}_{w}")
    for value in ("declined_count", "login_count", "login_failed", "new_device_login"):
        for w in ("1h", "1d"):
            found[f"{value}_{w}"] = F.col(f"{value}_{w}")
    n = F.col("txn_count_90d")
    amount = F.coalesce(F.col("amount"), F.lit(0))
    spread = n.cast("decimal(19,0)") * F.col("log_square_90d") - (
        F.col("log_90d").cast("decimal(19,0)") * F.col("log_90d").cast("decimal(19,0)")
    )
    deviation = F.sqrt(spread.cast("double")) / n
    centred = log_units(F.col("amount")) - F.col("log_90d") / n
    found.update(
        online_count_1d=F.col("online_count_1d"),
        foreign_count_1d=F.col("foreign_count_1d"),
        foreign_share_90d=share(F.col("foreign_count_90d"), n),
        amount_to_mean_90d=share(amount, share(F.col("txn_sum_90d"), n)),
        log_amount_z_90d=F.round(F.when((n >= 2) & (spread > 0), centred / deviation), 6),
        amount_to_max_prev=share(amount, F.col("amount_max")),
        login_hours_since_prev=hours_between(F.col("t"), F.col("login_at")),
        new_device_hours_since_prev=hours_between(F.col("t"), F.col("new_device_at")),
        fraud_alert_1d=F.col("fraud_alert_1d"),
        fraud_alert_30d=F.col("fraud_alert_30d"),
        fraud_block_30d=F.col("fraud_block_30d"),
        income_sum_90d=F.col("income_sum_90d"),
        balance_before=F.col("balance.balance_after"),
        amount_to_balance=share(F.col("amount"), F.col("balance.balance_after")),
    )
    return found


def operation_features(tape: DataFrame, snapshot: DataFrame, eligible_from: int) -> DataFrame:
    """One row per operation from `eligible_from` on, with every feature."""
    scored = p.is_operation() & (F.col("t") >= eligible_from)
    # Clients are counted once; all ordered passes follow that count.
    clients = plan_split(tape, ["client"], "t")
    rows = profile_at_rows(history(tape, clients), clients=clients).filter(scored).join(novelty(tape, clients), "id", "left")
    snap = snapshot.select(
        "client", "gender", "birth_day", "lifelong", *[F.col(f).alias(f"snap_{f}") for f in PROFILE_FIELDS]
    )
    types = dict(snapshot.dtypes)
    joined = rows.join(snap, "client", "left")
    at = {
        f: F.when(F.col(f"{f}_hit"), F.col(f"{f}_old").try_cast(types[f])).otherwise(F.col(f"snap_{f}"))
        for f in PROFILE_FIELDS
    }
    moment = F.col("t")
    since = {
        f"days_since_{m}": (moment - F.array_min(F.transform(F.filter("lifelong", lambda x: x["type"] == m), lambda x: x["t"])))
        / F.lit(float(DAY))
        for m in ("bank_registered", "app_registered")
    }
    city, merchant_city = at["city"], F.col("merchant_city")
    return joined.select(
        "id",
        "client",
        "t",
        *[c.alias(n) for n, c in row_features().items()],
        *[c.alias(n) for n, c in history_features().items()],
        *[F.col(f"{n}_hours_since_prev") for n in NOVELTY],
        *[F.coalesce(F.col(f"{n}_is_new"), F.lit(0)).alias(f"{n}_is_new") for n in NOVELTY],
        age_at(F.col("birth_day"), moment).alias("age"),
        F.coalesce("gender", F.lit(ABSENT)).alias("gender"),
        F.coalesce(at["region"], F.lit(ABSENT)).alias("region"),
        F.coalesce(at["income_type"], F.lit(ABSENT)).alias("income_type"),
        at["declared_income"].alias("declared_income"),
        sure(merchant_city != city).cast("int").alias("merchant_city_other"),
        *[F.when(c > 0, c).alias(n) for n, c in since.items()],
    )
