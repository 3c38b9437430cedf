"""Boundaries and leaks: T itself, window edges, the future."""

import pytest
from pyspark.sql import functions as F

from chronotape.functions.clock import DAY, HOUR
from chronotape.operators import asof as ao
from chronotape.operators import checks as cx
from chronotape.operators import features as fx
from chronotape.operators import operations as ops
from chronotape.operators import profile as px

T = 100 * DAY


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_cutoff_and_window_edges(tape):
    df = tape(
        {"t": T, "exact": True}, {"t": T - 1, "exact": True}, {"t": T - 30 * DAY, "exact": True},
        {"t": T - 30 * DAY - 1, "exact": True}, {"t": T + 1, "exact": True},
    )
    row = one(fx.aggregate(fx.with_actions(df), T, {"n": fx.count_where(F.col("action"), T, 30), "every": fx.count_where(F.col("action"), T)}))
    assert (row["n"], row["every"]) == (2, 3)


def test_label_window_is_open_at_T_and_closed_at_the_horizon(tape):
    end = T + 60 * DAY
    cases = {T: 1, T + 1: 0, end: 0, end + 1: 1}
    for moment, churned in cases.items():
        df = tape({"t": 99.0}, {"t": moment, "exact": True})
        assert one(fx.churn_labels(df, T))["churned"] == churned


def test_the_future_changes_no_feature(tape):
    past = [{"t": 50.0 + i, "type": "purchase", "reason": "purchase", "amount": 10 * i, "mcc": str(i % 3)} for i in range(20)]
    future = [{"t": 100.0 + i, "type": "purchase", "reason": "purchase", "amount": 999, "mcc": "9", "balance_after": 5, "account_id": "x"} for i in range(5)]
    a, b = fx.client_features(tape(*past), T), fx.client_features(tape(*past, *future), T)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_feature_count(tape):
    assert len(fx.client_features(tape({"t": 1.0}), T).columns) == 99


def test_balance_takes_the_last_value_of_each_account(tape):
    df = tape(
        {"t": 60.0, "account_id": "x", "balance_after": 100}, {"t": 95.0, "account_id": "x", "balance_after": 40},
        {"t": 95.0, "account_id": "x", "balance_after": 50}, {"t": 96.0, "account_id": "y", "balance_after": -7},
        {"t": 70.0, "exact": False, "account_id": "y", "balance_after": 3},
    )
    row = one(fx.account_balance(df, T, {"now": 0.0, "ago": 30.0}))
    assert row["now"] == 43
    assert row["ago"] == 100  # exactly 30 days old is not older than 30 days
    lost = df.withColumn("account_id", F.lit(None).cast("string"))
    with pytest.raises(cx.ContractError):
        cx.require_empty(fx.balance_without_account(lost), "balance without account")


def test_rolling_frame_is_closed_at_the_start_and_open_at_the_row(tape):
    purchase = {"type": "purchase", "reason": "purchase", "amount": 5}
    df = tape(
        {"t": T - HOUR - 1, "exact": True, **purchase}, {"t": T - HOUR, "exact": True, **purchase},
        {"t": T, "exact": True, **purchase}, {"t": T, "exact": True, **purchase},
    )
    got = {r["id"]: r["txn_count_1h"] for r in ops.history(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_z_score_of_equal_amounts_is_null(tape):
    df = tape(*[{"t": 1.0 + i, "type": "transfer_out", "amount": 777} for i in range(4)])
    rows = ops.history(df).select("id", ops.history_features()["log_amount_z_90d"].alias("z")).collect()
    assert [r["z"] for r in rows] == [None] * 4


def test_novelty_ignores_the_row_itself_and_its_instant(tape):
    buy = {"type": "purchase", "reason": "purchase"}
    df = tape({"t": 1.0, "mcc": "1", **buy}, {"t": 1.0, "mcc": "1", **buy}, {"t": 2.0, "mcc": "1", **buy}, {"t": 3.0, **buy})
    got = {r["id"]: r for r in ops.novelty(df).collect()}
    assert [got[i]["mcc_is_new"] for i in (0, 1, 2)] == [1, 1, 0]
    assert got[2]["mcc_hours_since_prev"] == 24.0
    assert 3 not in got


def test_asof_directions_ties_and_null_values(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("b", 10, 3)], "k string, t bigint, id bigint")
    right = spark.createDataFrame([("a", 10, 1, "x"), ("a", 10, 2, None), ("a", 12, 3, "z")], "k string, t bigint, s bigint, v string")

    def run(**options):
        return {r["id"]: (r["v"], r["hit"]) for r in ao.asof(left, right, ["k"], "t", ["v"], tie="s", **options).collect()}

    assert run() == {1: (None, True), 2: (None, True), 3: (None, False)}
    assert run(exact=False) == {1: (None, False), 2: (None, True), 3: (None, False)}
    assert run(direction="forward") == {1: ("x", True), 2: ("z", True), 3: (None, False)}
    assert run(direction="forward", exact=False) == {1: ("z", True), 2: ("z", True), 3: (None, False)}


def snapshot(spark):
    return spark.createDataFrame(
        [("a", "R1", 5, 200 * DAY), ("b", "R2", 6, 200 * DAY)], "client string, region string, children bigint, as_of bigint"
    )


def test_roll_back_takes_the_first_change_at_or_after_T(spark, tape):
    change = {"type": "profile_change", "field_name": "region"}
    df = tape(
        {"t": 99.0, "old_value": "past", **change}, {"t": T, "exact": True, "old_value": "at T", **change},
        {"t": 120.0, "old_value": "later", **change}, {"t": 110.0, "client": "b", "old_value": None, **change},
        {"t": 105.0, "type": "profile_change", "field_name": "children", "old_value": "many"},
    )
    rolled = {r["client"]: r for r in px.roll_back(snapshot(spark), df, T, ["region", "children"]).collect()}
    assert rolled["a"]["region"] == "at T"
    assert rolled["b"]["region"] is None        # a change without an old value: empty at T
    assert rolled["a"]["children"] is None and rolled["b"]["children"] == 6
    notes = px.unreadable_changes(snapshot(spark), df, T, ["region", "children"]).collect()
    assert [(r["client"], r["old_value"]) for r in notes] == [("a", "many")]
    with pytest.raises(cx.ContractError, match="snapshot older"):
        px.refuse_future_cutoff(snapshot(spark), 300 * DAY)


def test_milestones_strictly_before(spark):
    df = spark.sql(f"select array(struct('m' as type, {T}L as t), struct('m' as type, {T - 5 * DAY}L as t)) as lifelong")
    row = df.select(px.days_since_milestone("m", T).alias("d"), px.milestone_moment("m", T - 5 * DAY).alias("none")).first()
    assert (row["d"], row["none"]) == (5.0, None)
