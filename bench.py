"""Times the headline queries: one warm run, one measured run each; prints one JSON line."""

import json
import os
import sys
import time

from chronotape.session import local_session
from queries.catalogue import QUERIES

HEADLINE = [
    "S4_typed_payload", "Q6_payload_violations", "W13_causal_order", "Q19_client_digest",
    "W2_rolling_sum", "W7_novelty", "W9_spells", "J2_asof_forward", "J11_followed_within",
    "H1_profile_roll_back", "H6_client_feature_table", "H7_operation_features", "H8_lifecycle_stages", "A12_churn_label",
    "A15_value_counts", "A17_numeric_summary", "A23_bucket_scales", "A28_dependent_pairs", "A32_day_cube",
    "V2_value_vocabulary", "V9_event_encoding", "V11_client_samples", "V7_text_pieces", "F1_normalize_documents", "M4_apply_mask",
    "E1_roc_auc", "E6_paired_difference", "K3_broken_chains", "R4_rolling_stream",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cores, cores)
    taken: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            # Fits, of a vocabulary for one, are inside the time of the query that needs them.
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cores": cores,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
