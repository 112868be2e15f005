"""Wall time of headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1 timed run after a warm-up of the session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "metrics_left_ece", "latest_ground_truth", "daily_eval_dataset", "drift_metrics", "scorecard", "readiness_gate",
    "fit_temperature", "fit_platt", "normalize_text", "redact_pii", "injection_report", "dedupe_documents", "answer_quality",
    "hash_embedding", "sparse_search", "dense_search", "linear_router", "confidence_fusion", "capture_outcome", "upsert_latest",
    "metric_histograms", "probe_summary", "st_error_rate", "st_latency_quantiles", "st_failure_runs",
]


def main() -> None:
    from triagelens.catalog import all_queries
    from triagelens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    queries["section_key"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            t0 = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - t0)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
