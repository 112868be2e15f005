"""Scorecard, gate and readiness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import evaluation as E
from ..operators import gates as G
from ..operators import scorecard as S
from ..plans import readiness as R
from .ctes import ece_bin, with_ctes
from .evaluation import DAY, LOCAL, canary_sql, drift_day_sql, ece_sql
from .shape import shaped

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SCOPE = S.Scope.trailing(DAY)


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, {**LOCAL, **MORE})
        return fn

    return wrap


def tables(spark, d) -> dict:
    return {
        "requests": A.inference_requests(spark, d), "results": A.inference_results(spark, d),
        "workload": A.workload_daily(spark, d), "outcomes": A.reviewer_outcomes(spark, d),
        "handoffs": A.handoffs(spark, d), "dataset": A.evaluation_dataset(spark, d),
        "rollout_events": A.rollout_events(spark, d), "calibration_runs": A.calibration_runs(spark, d),
        "control_events": A.control_events(spark, d), "alert_states": A.alert_states(spark, d),
    }


_W = f"BETWEEN DATE '{SCOPE.start}' AND DATE '{SCOPE.end}'"
_B = f"BETWEEN DATE '{SCOPE.baseline_start}' AND DATE '{SCOPE.baseline_end}'"
_WAU = f"BETWEEN DATE '{SCOPE.wau_start}' AND DATE '{SCOPE.end}'"
_ESC = "avg(CASE WHEN predicted_decision = 'escalate' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_Q = "quantile_cont(resolution_seconds::DOUBLE, {p})"

_LAB = "source = 'inference_results' AND model_variant = 'primary' AND ground_truth_decision IS NOT NULL"
MORE: dict[str, str] = {
    "lab_cur": f"SELECT * FROM eval_ds WHERE eval_date {_W} AND {_LAB}",
    "lab_base": f"SELECT * FROM eval_ds WHERE eval_date {_B} AND {_LAB}",
    "closed_h": f"""SELECT h.handoff_id, h.request_id, h.tenant_id FROM handoffs h JOIN inf_requests r ON r.request_id = h.request_id
 WHERE h.queue_status = 'closed' AND CAST(r.created_at AS DATE) {_W}""",
    "cov": f"""SELECT (SELECT count(*) FROM inf_requests r JOIN inf_results s ON r.request_id = s.request_id
   WHERE CAST(r.created_at AS DATE) {_W} AND s.model_variant = 'primary')::DOUBLE
  / nullif((SELECT sum(eligible_tickets_total) FROM workload WHERE metric_date {_W}), 0) AS v""",
    "wau": f"""SELECT (SELECT count(DISTINCT o.reviewer_id) FROM outcomes o JOIN inf_requests r ON r.request_id = o.request_id
   AND r.tenant_id = o.tenant_id WHERE CAST(o.created_at AS DATE) {_WAU})::DOUBLE
  / nullif((SELECT max(active_agents_total) FROM workload WHERE metric_date {_WAU}), 0) AS v""",
    "fbc": """SELECT (SELECT count(*) FROM closed_h c WHERE EXISTS (SELECT 1 FROM outcomes o WHERE o.handoff_id = c.handoff_id))::DOUBLE
  / nullif((SELECT count(*) FROM closed_h), 0) AS v""",
    "kpi_rows": f"""
 SELECT 'assisted_coverage_pct' AS kpi_name, (SELECT v FROM cov) AS actual_value
 UNION ALL SELECT 'agent_weekly_active_usage_pct', (SELECT v FROM wau)
 UNION ALL SELECT 'feedback_completeness_pct', (SELECT v FROM fbc)
 UNION ALL SELECT 'top1_route_accuracy_pct', avg(is_route_correct::INTEGER)::DOUBLE FROM lab_cur
 UNION ALL SELECT 'escalation_precision_pct', count(*) FILTER (is_escalation_pred AND is_escalation_actual)::DOUBLE
   / nullif(count(*) FILTER (is_escalation_pred), 0) FROM lab_cur
 UNION ALL SELECT 'escalation_recall_pct', count(*) FILTER (is_escalation_pred AND is_escalation_actual)::DOUBLE
   / nullif(count(*) FILTER (is_escalation_actual), 0) FROM lab_cur
 UNION ALL SELECT 'ece', ece FROM ({ece_sql('lab_cur', '')})
 UNION ALL SELECT 'escalation_rate_reduction_pct', ((SELECT {_ESC} FROM lab_base) - (SELECT {_ESC} FROM lab_cur))
   / nullif((SELECT {_ESC} FROM lab_base), 0)
 UNION ALL SELECT 'median_handling_time_reduction_pct', ((SELECT {_Q.format(p=0.5)} FROM lab_base) - (SELECT {_Q.format(p=0.5)} FROM lab_cur))
   / nullif((SELECT {_Q.format(p=0.5)} FROM lab_base), 0)
 UNION ALL SELECT 'p90_handling_time_reduction_pct', ((SELECT {_Q.format(p=0.9)} FROM lab_base) - (SELECT {_Q.format(p=0.9)} FROM lab_cur))
   / nullif((SELECT {_Q.format(p=0.9)} FROM lab_base), 0)""",
    "kpi_goal": "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', '{c}', {v}::DOUBLE)" for n, c, v, _, _ in S.KPI_TARGETS) + ") t(kpi_name, comparator, target_value)",
    "card": """SELECT g.kpi_name, g.comparator, g.target_value, k.actual_value,
  CASE WHEN k.actual_value IS NULL THEN 'insufficient_data'
   WHEN (comparator = 'gte' AND actual_value >= target_value) OR (comparator = 'lte' AND actual_value <= target_value) THEN 'pass'
   ELSE 'fail' END AS status FROM kpi_goal g LEFT JOIN kpi_rows k USING (kpi_name)""",
}

_G = G.Gates(min_route_accuracy=0.30, min_escalation_recall=0.25, max_ece=0.50, max_abstain_rate=0.40, min_sample_size=3)


def _kpi_query(name: str, build):
    @register(f"kpi_{name}", f"SELECT kpi_name, round(actual_value, 6) AS actual_value FROM kpi_rows WHERE kpi_name = '{_KPI[name]}'")
    def _q(spark, d):
        return build(tables(spark, d)).filter(F.col("kpi_name") == _KPI[name]).select("kpi_name", "actual_value")


_KPI = {
    "assisted_coverage": "assisted_coverage_pct", "weekly_active_usage": "agent_weekly_active_usage_pct",
    "feedback_completeness": "feedback_completeness_pct", "route_accuracy": "top1_route_accuracy_pct",
    "escalation_precision": "escalation_precision_pct", "escalation_recall": "escalation_recall_pct", "ece": "ece",
    "escalation_rate_reduction": "escalation_rate_reduction_pct",
    "median_handling_reduction": "median_handling_time_reduction_pct", "p90_handling_reduction": "p90_handling_time_reduction_pct",
}
_kpi_query("assisted_coverage", lambda t: S.assisted_coverage(t["requests"], t["results"], t["workload"], SCOPE))
_kpi_query("weekly_active_usage", lambda t: S.weekly_active_usage(t["outcomes"], t["requests"], t["workload"], SCOPE))
_kpi_query("feedback_completeness", lambda t: S.feedback_completeness(t["handoffs"], t["requests"], t["outcomes"], SCOPE))
for _n in list(_KPI)[3:]:
    _kpi_query(_n, lambda t: S.labelled_kpis(t["dataset"], SCOPE))


@register("scorecard", """SELECT kpi_name, comparator, target_value, round(actual_value, 6) AS actual_value, status FROM card""")
def scorecard_query(spark, d):
    return S.scorecard(tables(spark, d), SCOPE).select("kpi_name", "comparator", "target_value", "actual_value", "status")


@register("targets_left_kpis", """SELECT kpi_name, status, CASE WHEN actual_value IS NULL THEN 'n/a'
 ELSE printf('%.2f%%', actual_value * 100) END AS formatted FROM (SELECT g.*, k.actual_value,
  CASE WHEN k.actual_value IS NULL THEN 'insufficient_data'
   WHEN (comparator = 'gte' AND actual_value >= target_value) OR (comparator = 'lte' AND actual_value <= target_value) THEN 'pass'
   ELSE 'fail' END AS status FROM kpi_goal g LEFT JOIN (SELECT * FROM kpi_rows WHERE kpi_name LIKE 'e%') k USING (kpi_name))""")
def _q(spark, d):
    kpis = S.labelled_kpis(A.evaluation_dataset(spark, d), SCOPE).filter(F.col("kpi_name").startswith("e"))
    return S.targets_left_kpis(S.kpi_targets(spark), kpis).select(
        "kpi_name", "status", S.format_value(F.col("unit"), F.col("actual_value")).alias("formatted"))


@register("params_join", f"""SELECT DATE '{SCOPE.wau_start}'::VARCHAR AS wau_start, count(*) AS n FROM outcomes
 WHERE CAST(created_at AS DATE) {_WAU}""")
def _q(spark, d):
    o = A.reviewer_outcomes(spark, d).filter(S._day_span(F.col("created_at"), SCOPE.wau_start, SCOPE.end))
    return o.agg(F.count(F.lit(1)).alias("n")).select(F.lit(SCOPE.wau_start).alias("wau_start"), "n")


@register("reviewers_in_scope", f"""SELECT o.request_id, o.tenant_id, o.reviewer_id, coalesce(r.section, '__all__') AS section
FROM outcomes o JOIN inf_requests r ON r.request_id = o.request_id AND r.tenant_id = o.tenant_id
WHERE CAST(o.created_at AS DATE) {_W}""")
def _q(spark, d):
    t = tables(spark, d)
    return S.reviewers_in_scope(t["outcomes"], t["requests"], SCOPE.start, SCOPE.end, SCOPE)


@register("closed_with_outcome", """SELECT c.handoff_id, c.request_id, c.tenant_id, coalesce(r.section, '__all__') AS section
FROM closed_h c JOIN inf_requests r ON r.request_id = c.request_id
WHERE EXISTS (SELECT 1 FROM outcomes o WHERE o.handoff_id = c.handoff_id)""")
def _q(spark, d):
    t = tables(spark, d)
    return S.closed_with_outcome(t["handoffs"], t["requests"], t["outcomes"], SCOPE)


@register("closed_missing_outcome", """SELECT h.handoff_id, h.request_id, h.tenant_id FROM handoffs h
LEFT JOIN (SELECT DISTINCT handoff_id FROM outcomes) o ON o.handoff_id = h.handoff_id
WHERE h.queue_status = 'closed' AND o.handoff_id IS NULL""")
def _q(spark, d):
    t = tables(spark, d)
    return S.closed_missing_outcome(t["handoffs"], t["outcomes"]).select("handoff_id", "request_id", "tenant_id")


@register("label_counts", """SELECT count(*) AS closed_handoffs,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.handoff_id = c.handoff_id)) AS missing_outcomes FROM closed_h c""")
def _q(spark, d):
    t = tables(spark, d)
    return S.label_counts(t["handoffs"], t["requests"], t["outcomes"], SCOPE)


_GAP_LO, _GAP_HI = "2001-07-01", "2001-09-15"


@register("date_gaps", f"""SELECT CAST(day AS VARCHAR) AS metric_date FROM (
 SELECT CAST(unnest(generate_series(DATE '{_GAP_LO}', DATE '{_GAP_HI}', INTERVAL 1 DAY)) AS DATE) AS day)
WHERE day NOT IN (SELECT metric_date FROM workload WHERE tenant_id = 'ASIA')""")
def _q(spark, d):
    return S.date_gaps(A.workload_daily(spark, d), _GAP_LO, _GAP_HI, "ASIA")


@register("workload_coverage", f"""SELECT count(n) AS present_dates, count(*) AS expected_dates, sum(coalesce(n, 0))::BIGINT AS row_count,
 coalesce(string_agg(CASE WHEN n IS NULL THEN CAST(day AS VARCHAR) END, '|' ORDER BY day), '') AS missing_dates,
 count(n) = count(*) AS passed FROM (
 SELECT CAST(unnest(generate_series(DATE '{_GAP_LO}', DATE '{_GAP_HI}', INTERVAL 1 DAY)) AS DATE) AS day)
LEFT JOIN (SELECT metric_date AS day, count(*) AS n FROM workload GROUP BY 1) USING (day)""")
def _q(spark, d):
    return S.workload_coverage(A.workload_daily(spark, d), _GAP_LO, _GAP_HI)


@register("workload_stats", """SELECT tenant_id, count(*) AS days, round(avg(eligible_tickets_total), 6) AS mean_tickets,
 min(eligible_tickets_total) AS min_tickets, max(eligible_tickets_total) AS max_tickets,
 round(avg(active_agents_total), 6) AS mean_agents, max(active_agents_total) - min(active_agents_total) AS agent_range,
 round(sum(eligible_tickets_total)::DOUBLE / sum(active_agents_total), 6) AS tickets_per_agent FROM workload GROUP BY 1""")
def _q(spark, d):
    return S.workload_stats(A.workload_daily(spark, d), ["tenant_id"])


def _daily_gate_sql(g: G.Gates, floor: int, lo: str, hi: str) -> str:
    return f"""SELECT *, reasons = '' AS passed FROM (SELECT *, array_to_string(list_filter([
  CASE WHEN sample_size < {floor} THEN 'sample_size_below_min_daily' END,
  CASE WHEN route_accuracy IS NULL OR route_accuracy < {g.min_route_accuracy} THEN 'route_accuracy_below_gate' END,
  CASE WHEN escalation_recall IS NULL OR escalation_recall < {g.min_escalation_recall} THEN 'escalation_recall_below_gate' END,
  CASE WHEN ece IS NULL OR ece > {g.max_ece} THEN 'ece_above_gate' END,
  CASE WHEN abstain_rate > {g.max_abstain_rate} THEN 'abstain_rate_above_gate' END], lambda x: x IS NOT NULL), '|') AS reasons
 FROM (SELECT eval_date, sample_size, route_accuracy, escalation_recall, ece, abstain_rate FROM ({canary_sql(
    f"eval_date BETWEEN DATE '{lo}' AND DATE '{hi}' AND model_variant='challenger' AND source='shadow:canary'", 'eval_date')})))"""


_CAN = """sample_size, round(route_accuracy, 6) AS route_accuracy, round(escalation_recall, 6) AS escalation_recall,
 round(ece, 6) AS ece, round(abstain_rate, 6) AS abstain_rate"""


@register("daily_gate", f"""SELECT CAST(eval_date AS VARCHAR) AS eval_date, {_CAN}, reasons, passed
FROM ({_daily_gate_sql(_G, 3, '1998-03-18', DAY)})""")
def daily_gate_query(spark, d):
    return G.daily_gate(E.canary_daily_metrics(A.evaluation_dataset(spark, d), "1998-03-18", DAY), _G, 1)


@register("stable_days", f"""SELECT least(28, coalesce(date_diff('day', max(day), DATE '{DAY}'), 28))::BIGINT AS stable_days FROM (
 SELECT CAST(unnest(generate_series(DATE '{DAY}' - 27, DATE '{DAY}', INTERVAL 1 DAY)) AS DATE) AS day)
WHERE day NOT IN (SELECT eval_date FROM (SELECT eval_date, count(*) AS n FROM eval_ds GROUP BY 1) WHERE n >= 14)""")
def _q(spark, d):
    days = A.evaluation_dataset(spark, d).groupBy("eval_date").agg((F.count(F.lit(1)) >= 14).alias("passed"))
    return G.stable_days(days, DAY, 28)


_PROGRESS = f"""WITH RECURSIVE promos AS (SELECT created_at, event_id, target_percent,
  row_number() OVER (ORDER BY created_at, event_id) AS rn FROM roll_events
  WHERE eval_date <= DATE '{DAY}' AND apply_change AND action = 'promote' AND target_percent IN (5, 25, 50, 100)),
 walk AS (SELECT 0::BIGINT AS rn, 0 AS reached UNION ALL
  SELECT p.rn, CASE WHEN w.reached < 4 AND p.target_percent = ([5, 25, 50, 100])[w.reached + 1] THEN w.reached + 1 ELSE w.reached END
  FROM walk w JOIN promos p ON p.rn = w.rn + 1)"""


@register("stage_progression", _PROGRESS + f"""
SELECT (SELECT max(reached) FROM walk)::BIGINT AS stages_reached,
 (SELECT CAST(arg_min(eval_date, (created_at, event_id)) AS VARCHAR) FROM roll_events WHERE eval_date <= DATE '{DAY}'
   AND apply_change AND action = 'promote' AND target_percent >= 5) AS canary_started,
 (SELECT CAST(arg_max(eval_date, (created_at, event_id)) AS VARCHAR) FROM roll_events WHERE eval_date <= DATE '{DAY}'
   AND apply_change AND action = 'promote' AND target_percent >= 100) AS full_rollout,
 (SELECT count(*) FROM roll_events WHERE eval_date <= DATE '{DAY}' AND apply_change AND action = 'rollback') AS rollbacks,
 (SELECT max(reached) FROM walk) = 4 AS complete""")
def _q(spark, d):
    return G.stage_progression(A.rollout_events(spark, d), DAY)


_LATEST_CAL = f"""SELECT count(*) AS scopes, min(sample_size) AS min_sample_size,
  greatest(0, date_diff('day', max(CAST(created_at AS DATE)), DATE '2001-08-01'))::BIGINT AS age_days FROM (
  SELECT *, row_number() OVER (PARTITION BY run_scope ORDER BY created_at DESC, run_id DESC) AS rn FROM cal_runs
  WHERE model_variant = 'primary') WHERE rn = 1"""


@register("latest_calibration", f"""SELECT *, scopes = 2 AND age_days <= 7 AND min_sample_size >= 100 AS passed FROM ({_LATEST_CAL})""")
def _q(spark, d):
    return G.latest_calibration(A.calibration_runs(spark, d), "2001-08-01", 7, 100)


def _controls_sql(limits: dict[str, int], as_of: str) -> str:
    vals = ", ".join(f"('{k}', {v}::BIGINT)" for k, v in limits.items())
    return f"""SELECT control_type, max_age_days, age_days, status, status = 'ok' AS passed,
  strftime(performed_at, '%Y-%m-%d %H:%M:%S') AS performed_at, evidence_uri FROM (SELECT c.*, performed_at, evidence_uri,
  greatest(0, date_diff('day', CAST(performed_at AS DATE), DATE '{as_of}'))::BIGINT * CASE WHEN performed_at IS NULL THEN NULL ELSE 1 END AS age_days,
  CASE WHEN performed_at IS NULL THEN 'missing_pass_event'
   WHEN control_type = 'incident_endpoint_verification' AND lower(trim(json_extract_string(details, '$.mode'))) <> 'live' THEN 'not_live_mode'
   WHEN date_diff('day', CAST(performed_at AS DATE), DATE '{as_of}') > max_age_days THEN 'stale' ELSE 'ok' END AS status
  FROM (VALUES {vals}) c(control_type, max_age_days) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
   PARTITION BY control_type ORDER BY performed_at DESC, event_id DESC) AS rn FROM ctl_events WHERE status = 'pass') WHERE rn = 1)
  USING (control_type))"""


@register("control_recency", _controls_sql(G.CONTROL_MAX_AGE_DAYS, "2001-09-10"))
def _q(spark, d):
    return G.control_recency(A.control_events(spark, d), "2001-09-10")


@register("security_control_recency", _controls_sql(G.SECURITY_CONTROL_MAX_AGE_DAYS, "2001-08-10"))
def _q(spark, d):
    return G.control_recency(A.control_events(spark, d), "2001-08-10", G.SECURITY_CONTROL_MAX_AGE_DAYS)


@register("stage_ladder", """SELECT p AS percent, coalesce(list_min(list_filter([0, 5, 25, 50, 100], lambda s: s > p)), p)::BIGINT AS next_stage,
 coalesce(list_max(list_filter([0, 5, 25, 50, 100], lambda s: s < p)), 0)::BIGINT AS previous_stage, n FROM (
 SELECT o_custkey % 101 AS p, count(*) AS n FROM orders GROUP BY 1)""")
def _q(spark, d):
    p = A.table(spark, d, "orders").groupBy((F.col("o_custkey") % 101).alias("percent")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("percent", G.stage_next(F.col("percent")).alias("next_stage"),
                    G.stage_prev(F.col("percent")).alias("previous_stage"), "n")


def _promote_sql(g: G.Gates, days: int, percent: int, scope: str, rollback: bool) -> str:
    src = "source = 'shadow:canary'" if scope == "canary_only" else "source LIKE 'shadow:%'"
    empty = "no_canary_samples" if scope == "canary_only" else "no_challenger_samples"
    nxt = min([s for s in G.STAGES if s > percent], default=percent)
    prv = max([s for s in G.STAGES if s < percent], default=0)
    fail_target = prv if rollback and percent > 0 else percent
    return f"""SELECT '{DAY}' AS eval_date, {days}::BIGINT AS lookback_days, 'challenger' AS model_variant,
  CASE WHEN blocking_reasons = '' THEN 'pass' ELSE 'blocked' END AS gate_result,
  CASE WHEN target_percent > {percent} THEN 'promote' WHEN target_percent < {percent} THEN 'rollback' ELSE 'hold' END AS action,
  target_percent <> {percent} AS apply_change, {str(rollback).upper()} AS rollback_on_fail, {percent}::BIGINT AS current_percent,
  target_percent, {_CAN}, '{scope}' AS source_scope, blocking_reasons FROM (
  SELECT *, CASE WHEN blocking_reasons = '' THEN {nxt} ELSE {fail_target} END::BIGINT AS target_percent FROM (
   SELECT *, array_to_string(list_filter([CASE WHEN sample_size <= 0 THEN '{empty}' END,
    CASE WHEN sample_size < {g.min_sample_size} THEN 'sample_size_below_gate' END,
    CASE WHEN route_accuracy IS NULL THEN 'missing_route_accuracy' END,
    CASE WHEN route_accuracy < {g.min_route_accuracy} THEN 'route_accuracy_below_gate' END,
    CASE WHEN escalation_recall IS NULL THEN 'missing_escalation_recall' END,
    CASE WHEN escalation_recall < {g.min_escalation_recall} THEN 'escalation_recall_below_gate' END,
    CASE WHEN ece IS NULL THEN 'missing_ece' END, CASE WHEN ece > {g.max_ece} THEN 'ece_above_gate' END,
    CASE WHEN abstain_rate > {g.max_abstain_rate} THEN 'abstain_rate_above_gate' END], lambda x: x IS NOT NULL), '|') AS blocking_reasons
   FROM ({canary_sql(f"eval_date > DATE '{DAY}' - {days} AND eval_date <= DATE '{DAY}' AND model_variant='challenger' AND {src}", '')})))"""


_LOOSE = G.Gates(min_route_accuracy=0.05, min_escalation_recall=0.05, max_ece=0.95, max_abstain_rate=0.95, min_sample_size=1)


@register("promote_canary", f"""{_promote_sql(G.Gates(), 28, 25, 'canary_only', True)}
UNION ALL {_promote_sql(_LOOSE, 28, 0, 'shadow_or_canary', False)}""")
def _q(spark, d):
    ds = A.evaluation_dataset(spark, d)
    a = G.promote_canary(E.canary_window_metrics(ds, DAY, 28, 25), G.Gates(), DAY, 25, 28, apply=True, rollback_on_fail=True)
    b = G.promote_canary(E.canary_window_metrics(ds, DAY, 28, 0), _LOOSE, DAY, 0, 28, apply=True)
    return a.unionByName(b)


def _rollout_tables(spark, d) -> dict:
    t = tables(spark, d)
    ds = t["dataset"]
    recent = ds.filter(F.col("eval_date").between(F.date_sub(F.lit(DAY).cast("date"), 14), F.lit(DAY).cast("date")))
    t["drift"] = E.drift_metrics(ds, E.metrics_with_ece(recent), DAY)
    return t


_CHECKS = f"""WITH stable AS (SELECT least(28, coalesce(date_diff('day', max(day), DATE '{DAY}'), 28)) AS v FROM (
  SELECT CAST(unnest(generate_series(DATE '{DAY}' - 27, DATE '{DAY}', INTERVAL 1 DAY)) AS DATE) AS day)
  WHERE day NOT IN (SELECT eval_date FROM ({_daily_gate_sql(_G, 50, '1998-05-19', DAY)}) WHERE passed)),
 dr AS (SELECT count(*) AS n, count(*) FILTER (is_alert) AS a FROM ({drift_day_sql(DAY)})),
 miss AS (SELECT count(*) AS n FROM handoffs h WHERE queue_status = 'closed' AND NOT EXISTS (
   SELECT 1 FROM outcomes o WHERE o.handoff_id = h.handoff_id)),
 lab AS (SELECT count(*) AS n FROM outcomes WHERE CAST(created_at AS DATE) BETWEEN DATE '{DAY}' - 13 AND DATE '{DAY}'),
 al AS (SELECT count(*) FILTER (firing) AS n FROM alert_days WHERE day BETWEEN DATE '{DAY}' - 13 AND DATE '{DAY}'),
 ord AS (SELECT min(CASE WHEN target_percent = 5 THEN 1 END) AS x FROM roll_events),
 cal AS (SELECT count(*) AS scopes, min(sample_size) AS s, greatest(0, date_diff('day', max(CAST(created_at AS DATE)), DATE '{DAY}')) AS age
  FROM (SELECT *, row_number() OVER (PARTITION BY run_scope ORDER BY created_at DESC, run_id DESC) AS rn FROM cal_runs
   WHERE model_variant = 'primary') WHERE rn = 1),
 promo AS (SELECT created_at, event_id, target_percent AS p FROM roll_events WHERE eval_date <= DATE '{DAY}' AND apply_change AND action = 'promote'),
 s1 AS (SELECT min((created_at, event_id)) AS k FROM promo WHERE p = 5),
 s2 AS (SELECT min((created_at, event_id)) AS k FROM promo, s1 WHERE p = 25 AND (created_at, event_id) > s1.k),
 s3 AS (SELECT min((created_at, event_id)) AS k FROM promo, s2 WHERE p = 50 AND (created_at, event_id) > s2.k),
 s4 AS (SELECT min((created_at, event_id)) AS k FROM promo, s3 WHERE p = 100 AND (created_at, event_id) > s3.k),
 chk AS (SELECT (SELECT v FROM stable) >= 14 AS quality_passed, (SELECT n > 0 AND a = 0 FROM dr) AS drift_passed,
  (SELECT n FROM miss) = 0 AND (SELECT n FROM lab) >= 50 AS labeling_passed, (SELECT n FROM al) = 0 AS slo_passed,
  (SELECT k IS NOT NULL FROM s4) AS canary_passed,
  (SELECT count(*) > 0 FROM roll_events WHERE eval_date <= DATE '{DAY}' AND apply_change AND action = 'rollback') AS rollback_drill_passed,
  (SELECT scopes = 2 AND s >= 200 AND age <= 7 FROM cal) AS calibration_passed),
 live AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT quality_passed THEN 'insufficient_stable_canary_window' END,
  CASE WHEN NOT drift_passed THEN 'drift_alerts_or_missing_drift_rows' END, CASE WHEN NOT labeling_passed THEN 'labeling_integrity_not_met' END,
  CASE WHEN NOT slo_passed THEN 'slo_breach_or_slo_check_unavailable' END, CASE WHEN NOT canary_passed THEN 'canary_progression_not_complete_to_100' END,
  CASE WHEN NOT rollback_drill_passed THEN 'rollback_drill_not_recorded' END,
  CASE WHEN NOT calibration_passed THEN 'calibration_requirements_not_met' END], lambda x: x IS NOT NULL), '|') AS blocking_reasons FROM chk)"""


@register("validate_rollout", _CHECKS + " SELECT *, blocking_reasons = '' AS overall_passed FROM live")
def _q(spark, d):
    return R.validate_rollout(_rollout_tables(spark, d), DAY, _G)


@register("readiness_gate", _CHECKS + f""", five AS (SELECT (SELECT blocking_reasons = '' FROM live) AS live_rollout_passed,
  (SELECT count(*) = 0 FROM card WHERE status <> 'pass') AS business_kpi_passed,
  (SELECT count(DISTINCT metric_date) = 28 FROM workload WHERE metric_date BETWEEN DATE '{DAY}' - 27 AND DATE '{DAY}') AS workload_feed_coverage_passed,
  (SELECT count(*) = 0 FROM closed_h c WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.handoff_id = c.handoff_id)) AS label_coverage_passed,
  (SELECT bool_and(passed) FROM ({_controls_sql(G.CONTROL_MAX_AGE_DAYS, '2001-09-10')})) AS control_recency_passed)
SELECT *, array_to_string(list_filter([CASE WHEN NOT live_rollout_passed THEN 'live_rollout_validation_blocked' END,
 CASE WHEN NOT business_kpi_passed THEN 'business_kpi_targets_not_met' END,
 CASE WHEN NOT workload_feed_coverage_passed THEN 'ops_workload_daily_has_missing_dates' END,
 CASE WHEN NOT label_coverage_passed THEN 'closed_handoffs_missing_outcomes' END,
 CASE WHEN NOT control_recency_passed THEN 'operational_control_recency_failed' END], lambda x: x IS NOT NULL), '|') AS blocking_reasons,
 live_rollout_passed AND business_kpi_passed AND workload_feed_coverage_passed AND label_coverage_passed AND control_recency_passed
  AS overall_passed FROM five""")
def _q(spark, d):
    return R.readiness_gate(_rollout_tables(spark, d), DAY, "2001-09-10", gates=_G)


@register("rollout_config_state", """SELECT 'primary' AS config_id, greatest(0, least(100, (SELECT max(o_custkey) FROM orders)))::BIGINT AS canary_percent,
 0.75::DOUBLE AS gate_min_route_accuracy, 0.7::DOUBLE AS gate_min_escalation_recall, 0.15::DOUBLE AS gate_max_ece,
 0.35::DOUBLE AS gate_max_abstain_rate, 1::BIGINT AS gate_min_sample_size""")
def _q(spark, d):
    cfg = A.table(spark, d, "orders").agg(F.max("o_custkey").alias("canary_percent")).select(
        F.lit("primary").alias("config_id"), "canary_percent",
        *[F.lit(None).cast("double").alias(c) for c in
          ("gate_min_route_accuracy", "gate_min_escalation_recall", "gate_max_ece", "gate_max_abstain_rate")],
        F.lit(0).alias("gate_min_sample_size"))
    return G.rollout_config_state(cfg, spark)
