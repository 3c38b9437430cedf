"""Payload contract, refusals, sinks, packing, masks."""

import pytest
from pyspark.sql import functions as F

from chronotape.operators import batches as bx
from chronotape.operators import checks as cx
from chronotape.operators import encoding as ex
from chronotape.operators import masking as mx
from chronotape.sources import raw as rx
from chronotape.sources import sinks

CATALOGUE = {"pay": {"amount": ("int", True), "rate": ("float", False), "ok": ("bool", False), "who": ("str", True)}}


def violations(spark, *payloads):
    raw = spark.createDataFrame(list(enumerate(payloads)), "id bigint, payload string")
    found = cx.payload_violations(raw, rx.catalogue_table(spark, CATALOGUE)).collect()
    return sorted((r["id"], r["kind"], r["field"]) for r in found)


def test_payload_rules(spark):
    got = violations(
        spark,
        '{"type":"pay","amount":1,"who":"x","rate":2}',
        '{"type":"pay","amount":true,"who":"x"}',
        '{"type":"pay","amount":null,"who":"x"}',
        '{"type":"pay","who":5,"amount":1.5,"more":1}',
        None,
        "{",
        "[1]",
        '{"type":"pay","amount":1,"who":"x","ok":0}',
    )
    assert got == [
        (1, "type_mismatch", "amount"),
        (2, "missing_required", "amount"),
        (3, "type_mismatch", "amount"),
        (3, "type_mismatch", "who"),
        (3, "unexpected_key", "more"),
        (4, "null_payload", None),
        (5, "unparseable", None),
        (6, "unparseable", None),
        (7, "type_mismatch", "ok"),
    ]


def test_samples_stop_at_twenty(spark):
    rows = cx.payload_violations(
        spark.range(50).select("id", F.lit(None).cast("string").alias("payload")), rx.catalogue_table(spark, CATALOGUE)
    )
    assert sorted(r["id"] for r in cx.violation_samples(rows).collect()) == list(range(20))


def test_two_types_of_one_field_are_refused(spark):
    raw = spark.createDataFrame([(1, "{}")], "id bigint, payload string")
    with pytest.raises(ValueError, match="declared both"):
        rx.typed_payload(raw, {"a": {"x": ("int", False)}, "b": {"x": ("str", False)}})


def test_strict_times(spark):
    good = ["2024-02-29T10:00:00+05:00", "2024-01-01T00:00:00.123456Z", "2024-12-31T23:59:59.5-03:30"]
    bad = ["2024-02-30T10:00:00+05:00", "2024-01-01T00:00:00", "2024-01-01 00:00:00Z", "2024-13-01T00:00:00Z", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "id int, event_time string")
    found = sorted(r["id"] for r in cx.unreadable_times(df).collect())
    assert found == list(range(len(good), len(good) + len(bad)))


def test_manifest_and_refusal(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema_version": 2, "period_start": "2024-02-01T00:00:00Z",\n "period_end": "2024-01-01T00:00:00Z", "events_rows": 3}')
    manifest = rx.read_manifest(spark, str(tmp_path / "m.json"))
    problems = cx.manifest_problems(manifest, 2)
    assert sorted(r["problem"] for r in problems.collect()) == ["empty window", "missing profile_rows"]
    with pytest.raises(cx.ContractError, match="manifest"):
        cx.require_empty(problems, "manifest")


def test_an_empty_table_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "empty")
    sinks.write_table(spark.range(5).filter("id > 9"), path)
    assert spark.read.parquet(path).schema.simpleString() == "struct<id:bigint>"


def test_feature_list(spark):
    text = sinks.feature_list(spark.createDataFrame([("b", "two"), ("a", "one")], "name string, description string"))
    assert text.splitlines()[2:] == ["| a | one |", "| b | two |"]


def test_snapshot_checks(spark):
    df = spark.sql(
        "select 'a' as client, 100L as as_of, array(struct('k1' as type, 50L as t, 's' as source_id), struct('k1' as type, 40L as t, null as source_id)) as lifelong, "
        "array(struct(3L as start_day, 100L as recorded)) as employment"
    )
    got = sorted(r["problem"] for r in cx.milestone_problems(df, 100, ["k1", "k2"], ["k1"]).collect())
    assert got == ["order", "repeated", "source"]
    got = sorted(r["problem"] for r in cx.employment_problems(df, lambda m: m * 0).collect())
    assert got == ["future", "start_after_record"]


def test_sample_invariants_name_what_is_broken(spark):
    good = {"client": "a", "key_ids": [3, 7, 7, 3], "value_ids": [3, 9, 10, 3], "positions": [0, 0, 1, 0], "event_starts": [0, 3], "event_lengths": [3, 1], "event_time": [1, 2], "target_event_mask": [True, False]}
    schema = "client string, key_ids array<int>, value_ids array<int>, positions array<int>, event_starts array<int>, event_lengths array<int>, event_time array<bigint>, target_event_mask array<boolean>"
    broken = {
        "length": {"positions": [0, 0, 1]}, "channels": {"event_time": [1]}, "cover": {"event_starts": [0, 2]},
        "marker": {"key_ids": [4, 7, 7, 3]}, "position": {"positions": [0, 0, 2, 0]}, "id range": {"value_ids": [3, 9, 99, 3]},
        "padding": {"value_ids": [3, 0, 10, 3]}, "time order": {"event_time": [2, 1]},
    }
    cases = [("good", good), *[(name, {**good, **change}) for name, change in broken.items()]]
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple({**row, "client": name}[n] for n in names) for name, row in cases], schema)
    found = {}
    for r in ex.sample_problems(df, 20).collect():
        found.setdefault(r["client"], set()).add(r["problem"])
    assert "good" not in found
    for name in broken:
        assert name in found[name], name


def test_values_of_tokens(spark):
    df = spark.createDataFrame([("a", 1, [3, 7, 7, 8, 9, 9, 9], [3, 1, 2, 3, 4, 5, 6], [0, 0, 1, 0, 0, 1, 2])], "client string, id bigint, key_ids array<int>, value_ids array<int>, positions array<int>")
    got = sorted((r["key_id"], r["start"], r["length"]) for r in ex.values_of(df).collect())
    assert got == [(7, 1, 2), (8, 3, 1), (9, 4, 3)]


def test_packing_equals_a_greedy_loop(spark):
    import random

    draw = random.Random(2)
    for costs, budget in (([draw.choice([1, 5, 40, 250]) for _ in range(300)], 100), ([7] * 65, 7), ([3], 1), ([1] * 50, 1000)):
        df = spark.createDataFrame(list(enumerate(costs)), "place bigint, cost bigint").repartition(4)
        got = {r["place"]: r["batch"] for r in bx.packed(df, budget).collect()}
        want, spent, batch = {}, 0, 0
        for i, c in enumerate(costs):
            if i and spent + c > budget:
                spent, batch = c, batch + 1
            else:
                spent += c
            want[i] = batch
        assert got == want
    assert bx.packed(df.limit(0), 10).count() == 0


def mask_rows(spark, n=3000):
    rows = [(f"c{i % 40}", i // 4, 5 + i % 4, 0, [100 + i % 9], i % 3 > 0, 0.15) for i in range(n)]
    return spark.createDataFrame(rows, "client string, id bigint, key_id int, place int, ids array<int>, target boolean, chance double")


def test_masks_do_not_depend_on_partitions(spark):
    rows = mask_rows(spark)
    config = mx.Masking(groups=((5, 6),), event_only_key=8)
    a = mx.choose(rows.repartition(1), config)
    b = mx.choose(rows.repartition(7, "key_id"), config)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_mask_rates_and_rules(spark):
    chosen = mx.choose(mask_rows(spark, 12000), mx.Masking(event_only_key=8)).collect()
    targets = [r for r in chosen if r["target"]]
    assert not [r for r in chosen if not r["target"] and r["reason"]]
    assert not [r for r in targets if r["key_id"] == 8 and r["reason"] in (2, 3)]
    events = {r["id"]: r["reason"] == 1 for r in targets}
    assert 0.07 < sum(events.values()) / len(events) < 0.13
    hit = [r for r in targets if r["reason"]]
    assert 0.06 < sum(r["unknown"] for r in hit) / len(hit) < 0.14
    other = mx.choose(mask_rows(spark, 12000), mx.Masking(seed=43, event_only_key=8)).collect()
    assert {(r["id"], r["key_id"], r["reason"]) for r in chosen} != {(r["id"], r["key_id"], r["reason"]) for r in other}


def test_overlapping_values_are_named(spark):
    df = spark.createDataFrame([("a", 1, 1, 2), ("a", 1, 2, 1), ("a", 2, 1, 2), ("a", 2, 3, 1)], "client string, id bigint, start int, length int")
    assert [(r["id"], r["start"]) for r in mx.overlaps(df).collect()] == [(1, 2)]


def test_a_client_of_white_space_is_blank(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "\t"), (3, " \n"), (4, None), (5, " ")], "id int, client_id string")
    assert sorted(r["id"] for r in cx.blank_client(rows).collect()) == [2, 3, 4, 5]


def test_a_type_that_is_no_text_is_no_type(spark):
    rows = spark.createDataFrame([(1, '{"type":5,"amount":1}'), (2, '{"type":"pay","amount":1}')], "id int, payload string")
    found = {r["id"]: (r["type"], r["amount"]) for r in rx.typed_payload(rows, CATALOGUE).collect()}
    assert found == {1: (None, None), 2: ("pay", 1)}


def encoded_rows(spark, *rows):
    """(client, t, tokens) as encoded events."""
    data = [(i, c, t, "x", [3] * n, [3] * n, [0] * n, n) for i, (c, t, n) in enumerate(rows)]
    return spark.createDataFrame(
        data, "id bigint, client string, t bigint, type string, key_ids array<int>, value_ids array<int>, positions array<int>, n_tokens int"
    )


def test_every_client_has_a_sample(spark):
    events = encoded_rows(spark, ("a", 1, 9), ("b", 1, 2), ("b", 2, 3), ("b", 3, 3))
    clients = spark.createDataFrame([("a",), ("b",), ("silent",)], "client string")
    out = {r["client"]: r for r in ex.samples(events, 10, 6, F.col("t") < 3, clients=clients).collect()}
    assert set(out) == {"a", "b", "silent"}
    assert out["a"]["event_time"] == [] and out["a"]["excluded_events"] == 1 and out["a"]["excluded_targets"] == 1
    assert out["b"]["event_time"] == [2, 3] and out["b"]["excluded_targets"] == 1 and out["b"]["target_event_mask"] == [True, False]
    assert out["silent"]["key_ids"] == [] and out["silent"]["excluded_events"] == 0
    rows = ex.samples(events, 10, 6, F.col("t") < 3, clients=clients)
    assert ex.sample_problems(rows.filter("client = 'silent'"), 10).count() == 0


def test_limits_are_refused_not_cut(spark):
    events = encoded_rows(spark, ("a", 1, 9))
    with pytest.raises(Exception, match="an event of client a takes 9 tokens; the limit is 5"):
        ex.samples(events, 10, 20, F.lit(True), max_event_tokens=5).collect()
    with pytest.raises(cx.ContractError, match="lost events"):
        ex.require_whole_targets(ex.samples(events, 10, 5, F.lit(True)))
