"""How often a plan reads files: ordered operators share one count and one layout of their tape."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(name, spark) -> str:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("E1_roc_auc", 3), ("W2_rolling_sum", 1), ("J2_asof_forward", 2), ("H7_operation_features", 3)])
def test_plans_read_few_files(spark, name, most):
    assert plan(name, spark).count("Relation [") <= most


def test_samples_read_the_tape_once(spark):
    """The encoded events are written; what is left reads them and the clients."""
    text = plan("V11_client_samples", spark)
    assert text.count("Relation [event_id") <= 1
    assert text.count("Relation [") <= 12


@pytest.mark.parametrize(("name", "most"), [("K8_episode_shares", 0), ("V12_event_type_from_tokens", 0), ("V11_client_samples", 0), ("A26_value_weights", 0), ("M4_apply_mask", 0)])
def test_plans_do_not_derive_the_tape_again(spark, name, most):
    """The tape is derived from its JSON once and stored, or its few counts are."""
    assert plan(name, spark).count("get_json_object") <= most


def test_tasks_of_the_tape_grow_with_its_rows(spark, monkeypatch):
    from queries import tables

    rows = tables.read(spark, SF, "events").count()
    monkeypatch.setattr(tables, "TAPE_ROWS", rows // 12)
    assert tables.tape(spark, SF).rdd.getNumPartitions() >= 12


def test_cells_find_their_key_where_they_are(spark):
    """The registry has no size that Spark knows; cells are not shuffled to meet it."""
    from queries import corpus

    executed = corpus.values(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in executed and executed.count("BroadcastHashJoin") == 2
