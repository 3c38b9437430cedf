"""Queries against their SQL at the smallest scale; FULL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ALL = entry.queries()
SQL = entry.oracle_sql()
QUICK = [
    "S4_typed_payload", "Q6_payload_violations", "Q9_milestone_problems", "P8_client_action", "A6_account_balance",
    "A23_bucket_scales", "A26_value_weights", "H6_client_feature_table", "H7_operation_features", "H10_products_held",
    "V4_final_vocabulary", "V11_client_samples", "M4_apply_mask", "E6_paired_difference", "K8_episode_shares",
    "R2_rewind_stream", "R4_rolling_stream", "R6_silence_stream", "R7_checked_batches",
]
# Everything below cuts its keys into slices when they are heavy.
SPLIT = [
    "W1_rolling_count", "W2_rolling_sum", "W3_hours_since_previous", "W4_last_value", "W5_running_maximum",
    "W7_novelty", "W9_spells", "W13_causal_order", "W14_recent_tail", "W15_offsets", "W16_trips", "W18_rolling_mean",
    "W20_yearly_growth", "W21_time_resolution", "W22_state_episodes", "J2_asof_forward", "J3_asof_backward_strict",
    "J11_followed_within", "J12_offers_until_stop", "Q11_split_clients", "Q16_balance_chain", "Q19_client_digest",
    "Q20_compare_exports", "S8_row_numbers", "T1_total_order", "T2_typed_domain_order", "T6_cost_deciles",
    "A22_quantile_edges", "A41_amount_by_type", "A33_volume_card", "V2_value_vocabulary", "E1_roc_auc",
    "E2_average_precision", "E5_best_threshold", "E7_stratified_folds", "E11_slice_auc", "M7_seeded_order",
    "M8_content_over_times", "R2_resume_rewind", "K8_episode_shares",
]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def check(spark, db, name):
    message = compare(ALL[name](spark, SF), db, SQL[name])
    assert message is None, message


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("FULL") else QUICK)
def test_query_equals_sql(spark, db, name):
    check(spark, db, name)


@pytest.mark.parametrize("name", SPLIT)
def test_split_query_equals_sql(splitting, db, name):
    check(splitting, db, name)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(ALL)
