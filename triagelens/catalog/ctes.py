"""Check SQL for the adapters, as named CTEs over the shared tables."""

from __future__ import annotations

import re

from ..adapters import PHRASES

_LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(CAST(l_shipdate AS DATE) AS VARCHAR))"
)
_LINE_DECISION = "CASE l_returnflag WHEN 'N' THEN 'recommend' WHEN 'A' THEN 'abstain' ELSE 'escalate' END"


def _section(k: str) -> str:
    return f"CASE WHEN {k} % 4 <> 0 THEN 's' || ({k} % 4) END"


_PHRASES = "([" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "])"

CTES: dict[str, str] = {
    "sup_requests": f"""
 SELECT 'c-' || conv_id || '-' || turn AS request_id, 'src' || (conv_id % 20) AS tenant_id,
  CASE WHEN conv_id % 2 = 0 THEN (['en', 'fr', 'xx'])[conv_id % 3 + 1] END AS section,
  concat_ws(' ', nullif({_PHRASES}[(conv_id + turn) % {len(PHRASES)} + 1], ''), text) AS issue_text,
  (['low', 'medium', 'high'])[conv_id % 3 + 1] AS risk_level FROM conversations WHERE role = 'user'""",
    "eval_ds": f"""
 SELECT CAST(l_shipdate AS DATE) AS eval_date, {_LINE_ID} AS request_id,
  't' || (l_suppkey % 5) AS tenant_id, {_section('l_partkey')} AS section,
  CASE WHEN l_linestatus = 'O' THEN 'primary' ELSE 'challenger' END AS model_variant,
  {_LINE_DECISION} AS predicted_decision,
  'route' || (l_partkey % 5) AS predicted_route,
  round(0.05::DOUBLE + 0.018::DOUBLE * l_quantity, 4) AS predicted_route_prob,
  abs(l_tax) * 10 AS escalation_prob, l_discount * 10 AS final_confidence,
  CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'escalate' ELSE 'recommend' END END
    AS ground_truth_decision,
  CASE WHEN o_orderstatus <> 'P' THEN 'route' || (o_custkey % 5) END AS ground_truth_route,
  CASE WHEN o_orderstatus <> 'P' THEN (l_partkey % 5) = (o_custkey % 5) END AS is_route_correct,
  l_returnflag = 'R' AS is_escalation_pred,
  (o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') AS is_escalation_actual,
  CAST(l_partkey % 17 + 1 AS INTEGER) AS issue_token_count,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(l_quantity * 60 AS INTEGER) END AS resolution_seconds,
  CASE WHEN l_linestatus = 'O' THEN 'inference_results'
       WHEN l_linenumber % 2 = 0 THEN 'shadow:canary' ELSE 'shadow:shadow' END AS source
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "inf_requests": f"""
 SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 't' || (o_custkey % 5) AS tenant_id,
  {_section('o_custkey')} AS section,
  '  order ' || o_orderkey || ' priority ' || o_orderpriority
    || CASE WHEN o_orderstatus = 'P' THEN ' still  waiting' ELSE ' ' END AS issue_text,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS risk_level,
  '{{"import_source":"' || CASE WHEN o_custkey % 3 = 0 THEN 'bitext' ELSE 'api' END || '"}}' AS context,
  o_orderdate AS created_at FROM orders""",
    "inf_results": """
 SELECT CAST(o_orderkey AS VARCHAR) AS request_id,
  CASE WHEN o_orderkey % 10 < 6 THEN 'recommend' WHEN o_orderkey % 10 < 8 THEN 'abstain' ELSE 'escalate' END AS decision,
  'route' || (o_custkey % 5) AS top_resolution_path, (o_custkey % 101) / 100.0::DOUBLE AS top_resolution_prob,
  (o_orderkey % 100) / 100.0::DOUBLE AS escalation_prob, (o_orderkey % 101) / 100.0::DOUBLE AS final_confidence,
  CASE WHEN o_orderkey % 4 = 0 THEN 'challenger' ELSE 'primary' END AS model_variant,
  o_orderkey % 50 = 0 AS model_backend_fallback, o_orderdate AS created_at FROM orders""",
    "shadow": f"""
 SELECT {_LINE_ID} AS shadow_id, CAST(l_orderkey AS VARCHAR) AS request_id, 't' || (l_suppkey % 5) AS tenant_id,
  'challenger' AS model_variant,
  CASE WHEN l_linenumber % 2 = 0 THEN 'canary' ELSE 'shadow' END AS traffic_bucket,
  CASE WHEN l_returnflag = 'A' THEN 'abstain' END AS decision,
  'route' || (l_partkey % 5) AS top_resolution_path,
  round(0.05::DOUBLE + 0.018::DOUBLE * l_quantity, 4) AS top_resolution_prob,
  abs(l_tax) * 10 AS escalation_prob, l_discount * 10 AS final_confidence,
  FALSE AS model_backend_fallback, l_shipdate AS created_at FROM lineitem""",
    "handoffs": """
 SELECT 'h' || o_orderkey AS handoff_id, CAST(o_orderkey AS VARCHAR) AS request_id,
  't' || (o_custkey % 5) AS tenant_id,
  CASE o_orderstatus WHEN 'P' THEN 'open' WHEN 'O' THEN 'in_review' ELSE 'closed' END AS queue_status,
  o_orderdate AS created_at FROM orders""",
    "outcomes": f"""
 SELECT {_LINE_ID} AS outcome_id, 'h' || l_orderkey AS handoff_id, CAST(l_orderkey AS VARCHAR) AS request_id,
  't' || (o_custkey % 5) AS tenant_id, 'rev' || o_custkey AS reviewer_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'escalate' ELSE 'recommend' END AS final_decision,
  'route' || (l_suppkey % 5) AS final_resolution_path, CAST(l_quantity * 60 AS INTEGER) AS resolution_seconds,
  l_shipdate AS created_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "feedback": f"""
 SELECT {_LINE_ID} AS event_id, CAST(l_orderkey AS VARCHAR) AS request_id, 't' || (o_custkey % 5) AS tenant_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'escalate' WHEN 1 THEN 'abstain' ELSE 'recommend' END AS accepted_decision,
  CASE WHEN l_partkey % 6 <> 0 THEN 'route' || (l_partkey % 5) END AS corrected_resolution_path,
  l_shipdate AS created_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'""",
    "workload": """
 SELECT CAST(o_orderdate AS DATE) AS metric_date, r_name AS tenant_id, count(*) AS eligible_tickets_total,
  count(DISTINCT o_custkey) AS active_agents_total, '__all__' AS section, 'ops_export' AS source
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "svc": """
 SELECT CAST(event_id AS VARCHAR) AS request_id, event_id, ts,
  CASE WHEN user_id % 10 = 0 THEN 'decision-model-serving' ELSE 'decision-api' END AS service,
  't' || (user_id % 5) AS tenant_id, 'u' || user_id AS user_id,
  CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'routing' ELSE 'generation' END AS stage,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE event_type WHEN 'signup' THEN 'abstain' WHEN 'purchase' THEN 'escalate' ELSE 'recommend' END AS decision,
  value / 100 AS duration_seconds, least(1.0::DOUBLE, value / 500) AS confidence,
  k + 1 AS token_count, k % 10 = 0 AS injection_blocked, k % 7 = 0 AS guardrail,
  CASE WHEN event_type NOT IN ('click', 'view') THEN (k % 11) / 10::DOUBLE END AS faithfulness,
  CASE WHEN event_type NOT IN ('click', 'view') THEN (k % 7) / 10::DOUBLE END AS hallucination,
  CASE WHEN event_type NOT IN ('click', 'view') THEN (k % 5) / 4::DOUBLE END AS citation_coverage,
  CASE WHEN event_type = 'click' THEN (k % 9) / 8::DOUBLE END AS evidence_score,
  CASE WHEN event_type <> 'error' THEN (k + 1) * 0.000002::DOUBLE END AS cost_dollars,
  CAST(k % 3 = 0 AS INTEGER) AS breaker_state FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "chunks": """
 SELECT 'doc_' || doc_id AS chunk_id, source AS tenant_id, lang AS section, 'd' || doc_id AS doc_id,
  CASE WHEN doc_id % 3 = 0 THEN 'runbook' ELSE 'external' END AS source,
  DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS updated_at, text AS text_content FROM documents""",
    "roll_events": """
 SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS eval_date,
  CASE o_orderstatus WHEN 'P' THEN 'promote' WHEN 'F' THEN 'rollback' ELSE 'hold' END AS action,
  o_custkey % 2 = 0 AS apply_change, ([5, 25, 50, 100])[o_orderkey % 4 + 1] AS target_percent, o_orderdate AS created_at
 FROM orders""",
    "cal_runs": """
 SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'routing_temperature' ELSE 'escalation_platt' END AS run_scope,
  CASE WHEN o_custkey % 5 = 0 THEN 'challenger' ELSE 'primary' END AS model_variant, o_custkey AS sample_size,
  o_orderdate AS created_at FROM orders""",
    "ctl_events": """
 SELECT o_orderkey AS event_id, (['incident_endpoint_verification', 'oncall_schedule_audit', 'secret_rotation',
   'access_review', 'incident_drill', 'rollback_drill', 'load_test', 'soak_test', 'failure_test'])[o_custkey % 9 + 1] AS control_type,
  CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS status, 'global' AS control_scope, o_orderdate AS performed_at,
  'cust' || o_custkey AS performed_by, 'evidence/' || o_orderkey AS evidence_uri,
  CASE WHEN o_orderkey % 2 = 0 THEN '{"mode":" Live "}' ELSE '{"mode":"dry_run"}' END AS details FROM orders""",
    "alert_days": """
 SELECT (['DecisionApiHighErrorRate', 'DecisionApiHighLatencyP95', 'ModelServingHighErrorRate'])[o_custkey % 3 + 1] AS alert_name,
  CAST(o_orderdate AS DATE) AS day, o_totalprice > 499000 AS firing FROM orders""",
    "passages": """
 SELECT 'q-' || item_id || '-' || t AS request_id, 'src' || t AS tenant_id,
  CASE WHEN t % 2 = 0 THEN 'en' END AS section, text AS issue_text,
  CASE WHEN item_id % 4 = 0 THEN 'high' ELSE 'low' END AS risk_level
 FROM benchmark, (SELECT unnest(range(20)) AS t)""",
}


def ece_bin(conf: str) -> str:
    """Bucket number of a confidence: 0 below zero, 1..10, 11 from one up."""
    c = f"coalesce({conf}, 0.0)"
    return f"CASE WHEN {c} < 0 THEN 0 WHEN {c} >= 1 THEN 11 ELSE CAST(floor({c} * 10) AS INTEGER) + 1 END"


def r4(expr: str) -> str:
    """Four decimals from the shortest decimal form, not from scaled binary."""
    return f"round(CAST({expr} AS DECIMAL(30, 18)), 4)::DOUBLE"


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every named CTE it (transitively) mentions.

    ``body`` may itself start with ``WITH``; its CTEs are merged in.
    """
    pool = dict(CTES)
    if extra:
        pool.update(extra)
    needed: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in pool:
            if name in seen or name in needed:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(pool[name], seen + (name,))
                if name not in needed:
                    needed.append(name)

    visit(body, ())
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({pool[n]})" for n in needed)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        rest = stripped[15:].lstrip()
        return f"WITH RECURSIVE {head}{' ' if rest[:6].upper() == 'SELECT' else ','}\n{rest}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head},\n{stripped[5:]}"
    return f"WITH {head}\n{stripped}"
