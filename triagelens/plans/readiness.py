"""Gate chain: rollout validation, then production readiness."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import gates as G
from ..operators import scorecard as S


def validate_rollout(
    tables: dict[str, DataFrame],
    end_date: str,
    gates: G.Gates = G.Gates(),
    stable_days_min: int = 14,
    stable_days_max: int = 28,
    min_daily_samples: int = 50,
    min_ground_truth: int = 50,
    min_calibration_samples: int = 200,
    max_calibration_age_days: int = 7,
    model_variant: str = "challenger",
    tenant_id: str | None = None,
    section: str | None = None,
    skip_slo_check: bool = False,
    current_percent: int = 100,
) -> DataFrame:
    """Seven checks and the blocking reasons as one report row.

    ``tables`` holds dataset, drift, handoffs, outcomes, rollout_events,
    calibration_runs and alert_states (alert_name, day, firing).
    """
    end = date.fromisoformat(end_date)
    need = max(1, int(stable_days_min))
    history = max(need, int(stable_days_max))
    quality_start = (end - timedelta(days=need - 1)).isoformat()
    daily = E.canary_daily_metrics(
        tables["dataset"], (end - timedelta(days=history - 1)).isoformat(), end_date, model_variant, tenant_id, section)
    stable = G.stable_days(G.daily_gate(daily, gates, min_daily_samples), end_date, history)
    drift = E.drift_alert_counts(tables["drift"], quality_start, end_date, tenant_id, section)
    missing = S.closed_missing_outcome(tables["handoffs"], tables["outcomes"], tenant_id).agg(
        F.count(F.lit(1)).alias("missing"), F.lit(0).cast("bigint").alias("labelled"))
    labelled = E.optional_filter(
        tables["outcomes"].filter(S._day_span(F.col("created_at"), date.fromisoformat(quality_start), end)),
        F.col("tenant_id"), tenant_id,
    ).agg(F.lit(0).cast("bigint").alias("missing"), F.count(F.lit(1)).alias("labelled"))
    labels = missing.unionByName(labelled).agg(F.sum("missing").alias("missing"), F.sum("labelled").alias("labelled"))
    stages = G.stage_progression(tables["rollout_events"], end_date)
    calibration = G.latest_calibration(
        tables["calibration_runs"], end_date, max_calibration_age_days, min_calibration_samples)
    alerts = tables["alert_states"].filter(
        F.col("alert_name").isin(G.SLO_ALERTS)
        & F.col("day").between(F.lit(quality_start).cast("date"), F.lit(end_date).cast("date"))
    ).agg(F.count_if("firing").alias("breaches"))
    return G.combine_checks([
        (stable, F.col("stable_days") >= need, "quality_passed", "insufficient_stable_canary_window"),
        (drift, (F.col("total_rows") > 0) & (F.col("alert_rows") == 0), "drift_passed", "drift_alerts_or_missing_drift_rows"),
        (labels, (F.col("missing") == 0) & (F.col("labelled") >= min_ground_truth), "labeling_passed", "labeling_integrity_not_met"),
        (alerts, F.lit(skip_slo_check) | (F.col("breaches") == 0), "slo_passed", "slo_breach_or_slo_check_unavailable"),
        (stages, F.col("complete") & F.col("full_rollout").isNotNull() & F.lit(current_percent == 100),
         "canary_passed", "canary_progression_not_complete_to_100"),
        (stages, F.col("rollbacks") > 0, "rollback_drill_passed", "rollback_drill_not_recorded"),
        (calibration, F.col("passed"), "calibration_passed", "calibration_requirements_not_met"),
    ])


def readiness_gate(tables: dict[str, DataFrame], end_date: str, as_of: str, window_days: int = 28,
                   baseline_days: int = 28, tenant_id: str | None = None, section: str | None = None, **rollout) -> DataFrame:
    """Rollout, KPI, workload, label and control checks as one row."""
    window_days, baseline_days = max(7, int(window_days)), max(7, int(baseline_days))
    scope = S.Scope.trailing(end_date, window_days, baseline_days, tenant_id=tenant_id, section=section)
    live = validate_rollout(
        tables, end_date, stable_days_min=min(window_days, 14), stable_days_max=max(window_days, 28),
        tenant_id=tenant_id, section=section, **rollout)
    card = S.scorecard(tables, scope).agg(F.count_if(F.col("status") != "pass").alias("not_passed"))
    workload = S.workload_coverage(tables["workload"], scope.start.isoformat(), end_date, tenant_id, section)
    labels = S.label_counts(tables["handoffs"], tables["requests"], tables["outcomes"], scope)
    controls = G.control_recency(tables["control_events"], as_of).agg(F.bool_and("passed").alias("all_ok"))
    return G.combine_checks([
        (live, F.col("overall_passed"), "live_rollout_passed", "live_rollout_validation_blocked"),
        (card, F.col("not_passed") == 0, "business_kpi_passed", "business_kpi_targets_not_met"),
        (workload, F.col("passed"), "workload_feed_coverage_passed", "ops_workload_daily_has_missing_dates"),
        (labels, F.col("missing_outcomes") == 0, "label_coverage_passed", "closed_handoffs_missing_outcomes"),
        (controls, F.col("all_ok"), "control_recency_passed", "operational_control_recency_failed"),
    ])
