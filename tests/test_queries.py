"""A spread of registered queries against their check SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tests.harness import compare, duck
from triagelens.catalog import all_oracles, all_queries

NAMES = [
    "metrics_left_ece", "daily_eval_dataset", "drift_metrics", "scorecard", "promote_canary", "stage_progression", "readiness_gate",
    "recalibrate", "redact_pii", "scan_injection", "answer_quality", "build_corpus", "sparse_search", "dense_search", "decide",
    "upsert_latest", "capture_outcome", "metric_histograms", "st_error_rate", "st_failure_runs", "st_throttle_audit", "st_alerts_stateful",
    "routing_model", "embedding_backend", "metric_gauges", "metric_counters", "set_subset", "positional_postings", "st_pipeline_latency",
]


#: Has no rows on the smallest tables.
LARGER = {"drift_metrics": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    if name in LARGER:
        sf_dir = LARGER[name]
        con = duck(sf_dir)
    status, note, _, _ = compare(spark, con, name, all_queries()[name], all_oracles()[name], sf_dir)
    assert status == "ok", note


def test_every_check_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
