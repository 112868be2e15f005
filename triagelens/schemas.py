"""Column types of the stored tables and their data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table columns in order; JSON documents are strings.
_DDL: dict[str, str] = {
    "tenants": "tenant_id string, name string, status string, created_at timestamp",
    "doc_chunks": "chunk_id string, tenant_id string, section string, doc_id string, source string, updated_at date, "
                  "text_content string, embedding array<float>, created_at timestamp",
    "inference_requests": "request_id string, tenant_id string, section string, issue_text string, risk_level string, "
                          "context string, created_at timestamp, deleted_at timestamp",
    "inference_results": "request_id string, decision string, top_resolution_path string, top_resolution_prob double, "
                         "escalation_prob double, final_confidence double, trace_id string, policy_result string, "
                         "response_payload string, created_at timestamp, model_variant string, model_backend_fallback boolean, "
                         "detected_intent string, detected_category string, pii_redacted boolean, deleted_at timestamp",
    "handoffs": "handoff_id string, request_id string, tenant_id string, reason_codes array<string>, handoff_payload string, "
                "queue_status string, created_at timestamp, deleted_at timestamp",
    "feedback_events": "event_id string, request_id_text string, request_id string, tenant_id string, accepted_decision string, "
                       "corrected_resolution_path string, notes string, payload string, created_at timestamp, deleted_at timestamp",
    "reviewer_outcomes": "outcome_id string, handoff_id string, request_id string, tenant_id string, reviewer_id string, "
                         "final_decision string, final_resolution_path string, notes string, resolution_seconds int, "
                         "payload string, created_at timestamp",
    "model_shadow_predictions": "shadow_id string, request_id string, tenant_id string, model_name string, model_version string, "
                                "model_variant string, traffic_bucket string, route_probabilities string, top_resolution_path string, "
                                "top_resolution_prob double, escalation_prob double, final_confidence double, decision string, "
                                "model_backend_fallback boolean, metadata string, created_at timestamp",
    "model_rollout_config": "config_id string, challenger_model_name string, challenger_model_version string, canary_percent int, "
                            "gate_min_route_accuracy double, gate_min_escalation_recall double, gate_max_ece double, "
                            "gate_max_abstain_rate double, gate_min_sample_size int, updated_at timestamp",
    "evaluation_daily_dataset": "eval_date date, request_id string, tenant_id string, section string, model_variant string, "
                                "predicted_decision string, predicted_route string, predicted_route_prob double, escalation_prob double, "
                                "final_confidence double, ground_truth_decision string, ground_truth_route string, "
                                "is_route_correct boolean, is_escalation_pred boolean, is_escalation_actual boolean, "
                                "issue_token_count int, resolution_seconds int, source string, created_at timestamp",
    "evaluation_daily_metrics": "eval_date date, tenant_id string, section string, model_variant string, sample_size bigint, "
                                "route_accuracy double, escalation_precision double, escalation_recall double, ece double, "
                                "abstain_rate double, avg_time_to_resolution_seconds double, computed_at timestamp",
    "drift_daily_metrics": "drift_date date, tenant_id string, section string, metric_name string, baseline_value double, "
                           "current_value double, delta_value double, threshold double, is_alert boolean, details string, created_at timestamp",
    "model_calibration_runs": "run_id string, run_scope string, model_variant string, sample_size bigint, metrics string, "
                              "artifact_path string, created_at timestamp",
    "model_rollout_events": "event_id string, eval_date date, lookback_days int, model_variant string, gate_result string, action string, "
                            "apply_change boolean, rollback_on_fail boolean, current_percent int, target_percent int, sample_size bigint, "
                            "route_accuracy double, escalation_recall double, ece double, abstain_rate double, gates string, details string, "
                            "created_at timestamp",
    "rollout_validation_reports": "report_id string, window_start date, window_end date, stable_days_required int, "
                                  "stable_days_observed int, min_daily_samples int, quality_passed boolean, drift_passed boolean, "
                                  "labeling_passed boolean, slo_passed boolean, canary_passed boolean, rollback_drill_passed boolean, "
                                  "calibration_passed boolean, overall_passed boolean, blocking_reasons string, summary string, created_at timestamp",
    "ops_workload_daily": "metric_date date, tenant_id string, section string, eligible_tickets_total int, active_agents_total int, "
                          "source string, created_at timestamp, updated_at timestamp",
    "business_kpi_targets": "kpi_name string, comparator string, target_value double, unit string, description string, "
                            "created_at timestamp, updated_at timestamp",
    "operational_control_events": "event_id string, control_type string, status string, control_scope string, performed_at timestamp, "
                                  "performed_by string, evidence_uri string, details string, created_at timestamp",
    "intent_taxonomy": "intent_id string, category string, description string, risk_level string, keywords string, escalation_hint float, "
                       "is_active boolean, created_at timestamp, updated_at timestamp",
    "pii_audit_events": "event_id string, request_id string, tenant_id string, entity_types string, redacted_count int, "
                        "source_field string, created_at timestamp",
    "reindex_jobs": "job_id string, tenant_id string, section string, status string, chunks_indexed int, error_message string, "
                    "created_at timestamp, started_at timestamp, completed_at timestamp",
    "dataset_imports": "import_id string, dataset_source string, dataset_version string, record_count int, import_type string, "
                       "imported_at timestamp, imported_by string, metadata string",
    "data_retention_policies": "policy_id string, table_name string, retention_days int, action string, is_active boolean, "
                               "created_at timestamp, updated_at timestamp",
    "erasure_requests": "erasure_id string, tenant_id string, requested_by string, reason string, status string, tables_affected string, "
                        "records_deleted int, requested_at timestamp, completed_at timestamp, error_message string",
    "data_lifecycle_events": "event_id string, event_type string, tenant_id string, table_name string, records_affected int, "
                             "performed_by string, metadata string, created_at timestamp",
}
PARTITIONS = {
    "evaluation_daily_dataset": ["eval_date"], "evaluation_daily_metrics": ["eval_date"], "drift_daily_metrics": ["drift_date"],
    "ops_workload_daily": ["metric_date"],
}
KEYS = {
    "tenants": ["tenant_id"], "doc_chunks": ["chunk_id"], "inference_requests": ["request_id"], "inference_results": ["request_id"],
    "handoffs": ["handoff_id"], "ops_workload_daily": ["metric_date", "tenant_id", "section"], "business_kpi_targets": ["kpi_name"],
    "evaluation_daily_dataset": ["eval_date", "request_id", "model_variant", "source"],
    "evaluation_daily_metrics": ["eval_date", "tenant_id", "section", "model_variant"],
    "drift_daily_metrics": ["drift_date", "tenant_id", "section", "metric_name"], "model_rollout_config": ["config_id"],
}
# Allowed values and ranges per table, as SQL conditions.
CHECKS: dict[str, list[tuple[str, str]]] = {
    "inference_results": [("decision", "decision IN ('recommend', 'abstain', 'escalate')")],
    "handoffs": [("queue_status", "queue_status IN ('open', 'in_review', 'resolved', 'closed')")],
    "reviewer_outcomes": [
        ("final_decision", "final_decision IN ('recommend', 'abstain', 'escalate')"),
        ("resolution_seconds", "resolution_seconds IS NULL OR resolution_seconds >= 0")],
    "model_shadow_predictions": [("traffic_bucket", "traffic_bucket IN ('shadow', 'canary')")],
    "model_rollout_config": [("canary_percent", "canary_percent BETWEEN 0 AND 100")],
    "model_rollout_events": [
        ("gate_result", "gate_result IN ('pass', 'blocked')"), ("action", "action IN ('promote', 'rollback', 'hold')")],
    "ops_workload_daily": [
        ("eligible_tickets_total", "eligible_tickets_total >= 0"), ("active_agents_total", "active_agents_total >= 0")],
    "business_kpi_targets": [("comparator", "comparator IN ('gte', 'lte')")],
    "operational_control_events": [
        ("control_type", "control_type IN ('incident_endpoint_verification', 'oncall_schedule_audit', 'secret_rotation', "
         "'access_review', 'incident_drill', 'rollback_drill', 'load_test', 'soak_test', 'failure_test')"),
        ("status", "status IN ('pass', 'fail', 'waived')")],
    "data_retention_policies": [("action", "action IN ('soft_delete', 'hard_delete', 'anonymize')")],
    "erasure_requests": [("status", "status IN ('pending', 'in_progress', 'completed', 'failed')")],
    "data_lifecycle_events": [
        ("event_type", "event_type IN ('retention_purge', 'erasure_request', 'erasure_completed', 'key_rotation', "
         "'secret_rotation', 'export_request')")],
}
TABLES = sorted(_DDL)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order and type; missing ones are NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields])


def check_constraints(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Violations per rule in one pass; NULL counts as satisfied, as in SQL."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(f"NOT ({cond})")).alias(f"r{i}") for i, (_, cond) in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations"), F.col("rows")) for i, (n, _) in enumerate(rules)])
    return one.select(F.inline(cells))
