"""Evaluation, drift, canary and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import calibration as C
from ..operators import evaluation as E
from .ctes import ece_bin, with_ctes
from .shape import shaped

DAY = "1998-06-15"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, LOCAL)
        return fn

    return wrap


def _rate(flag: str) -> str:
    return f"avg(CASE WHEN {flag} THEN 1.0::DOUBLE WHEN NOT {flag} THEN 0.0::DOUBLE END)"


def quality_sql(keys: str) -> str:
    return f"""count(*) AS sample_size, {_rate('is_route_correct')} AS route_accuracy,
  count(*) FILTER (is_escalation_pred AND is_escalation_actual)::DOUBLE
    / nullif(count(*) FILTER (is_escalation_pred), 0) AS escalation_precision,
  count(*) FILTER (is_escalation_pred AND is_escalation_actual)::DOUBLE
    / nullif(count(*) FILTER (is_escalation_actual), 0) AS escalation_recall,
  avg(CASE WHEN predicted_decision = 'abstain' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS abstain_rate,
  avg(resolution_seconds::DOUBLE) AS avg_time_to_resolution_seconds"""


def ece_sql(source: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k} sum(abs(avg_acc - avg_conf) * n_bin) / nullif(sum(n_bin), 0)::DOUBLE AS ece, count(*) AS ece_bins
 FROM (SELECT {k} {ece_bin('final_confidence')} AS bin_id, count(*) AS n_bin,
   avg(coalesce(final_confidence, 0.0::DOUBLE)) AS avg_conf, {_rate('is_route_correct')} AS avg_acc
  FROM {source} WHERE is_route_correct IS NOT NULL GROUP BY {k} bin_id) {g}"""


_K = "eval_date, tenant_id, section, model_variant"
LOCAL: dict[str, str] = {
    "eval_keyed": "SELECT * REPLACE (coalesce(section, '__all__') AS section) FROM eval_ds",
    "daily_agg": f"SELECT {_K}, {quality_sql(_K)} FROM eval_keyed GROUP BY {_K}",
    "daily_ece": ece_sql("eval_keyed", _K),
    "daily_metrics": f"SELECT a.*, e.ece FROM daily_agg a LEFT JOIN daily_ece e USING ({_K})",
    "pred_events": """
 SELECT CAST(r.created_at AS DATE) AS eval_date, r.request_id, r.tenant_id, r.section, r.issue_text, s.model_variant,
  s.decision AS predicted_decision, s.top_resolution_path AS predicted_route, s.top_resolution_prob AS predicted_route_prob,
  s.escalation_prob, s.final_confidence, s.model_backend_fallback, 'inference_results' AS source
 FROM inf_requests r JOIN inf_results s ON r.request_id = s.request_id
 UNION ALL
 SELECT CAST(p.created_at AS DATE), p.request_id, p.tenant_id, r.section, r.issue_text, p.model_variant,
  coalesce(p.decision, CASE WHEN p.escalation_prob >= 0.5 THEN 'escalate' ELSE 'recommend' END),
  p.top_resolution_path, p.top_resolution_prob, p.escalation_prob, p.final_confidence, p.model_backend_fallback,
  'shadow:' || p.traffic_bucket
 FROM shadow p JOIN inf_requests r ON p.request_id = r.request_id AND p.tenant_id = r.tenant_id""",
    "latest_rev": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, tenant_id
  ORDER BY created_at DESC, outcome_id DESC) AS rn FROM outcomes) WHERE rn = 1""",
    "latest_fb": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, tenant_id
  ORDER BY created_at DESC, event_id DESC) AS rn FROM feedback) WHERE rn = 1""",
    "ground_truth": """
 SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.tenant_id, b.tenant_id) AS tenant_id,
  a.final_decision AS reviewer_final_decision, a.final_resolution_path AS reviewer_final_resolution_path,
  b.accepted_decision AS feedback_decision, b.corrected_resolution_path AS feedback_resolution_path,
  coalesce(a.final_decision, b.accepted_decision) AS ground_truth_decision,
  coalesce(a.final_resolution_path, b.corrected_resolution_path) AS ground_truth_route,
  a.resolution_seconds, coalesce(a.created_at, b.created_at) AS ground_truth_created_at
 FROM latest_rev a FULL OUTER JOIN latest_fb b ON a.request_id = b.request_id AND a.tenant_id = b.tenant_id""",
    "logged_ds": """
 SELECT e.eval_date, e.request_id, e.tenant_id, e.section, e.model_variant, e.predicted_decision, e.predicted_route,
  e.predicted_route_prob, e.escalation_prob, e.final_confidence, g.ground_truth_decision, g.ground_truth_route,
  CASE WHEN g.ground_truth_route IS NULL OR e.predicted_route IS NULL THEN NULL
   ELSE g.ground_truth_route = e.predicted_route END AS is_route_correct,
  coalesce(e.predicted_decision = 'escalate', FALSE) AS is_escalation_pred,
  coalesce(g.ground_truth_decision = 'escalate', FALSE) AS is_escalation_actual,
  greatest(1, len(regexp_split_to_array(trim(e.issue_text), '\\s+')))::BIGINT AS issue_token_count,
  g.resolution_seconds, e.source
 FROM pred_events e LEFT JOIN ground_truth g ON g.request_id = e.request_id AND g.tenant_id = e.tenant_id""",
    "drift_src": f"""
 SELECT tenant_id, section, eval_date, 'input_token_mean_relative_delta' AS metric_name, issue_token_count::DOUBLE AS v,
   0.30::DOUBLE AS threshold FROM eval_keyed
 UNION ALL SELECT tenant_id, section, eval_date, 'confidence_mean_abs_delta', final_confidence, 0.12::DOUBLE FROM eval_keyed
 UNION ALL SELECT tenant_id, section, eval_date, 'route_accuracy_abs_delta', route_accuracy, 0.10::DOUBLE FROM daily_metrics
   WHERE model_variant = 'primary'""",
}


def drift_day_sql(day: str, baseline: int = 14) -> str:
    return f"""
 SELECT tenant_id, section, metric_name, round(current_value, 6) AS current_value, round(baseline_value, 6) AS baseline_value,
  round(delta_value, 6) AS delta_value, threshold, delta_value > threshold AS is_alert, '{day}' AS drift_date
 FROM (SELECT *, CASE WHEN metric_name LIKE 'input%'
     THEN abs(current_value - baseline_value) / greatest(abs(baseline_value), 1.0) ELSE abs(current_value - baseline_value)
     END AS delta_value
  FROM (SELECT tenant_id, section, metric_name, threshold, c AS current_value, coalesce(b, c) AS baseline_value
   FROM (SELECT tenant_id, section, metric_name, threshold,
     avg(v) FILTER (eval_date = DATE '{day}') AS c,
     avg(v) FILTER (eval_date >= DATE '{day}' - {baseline} AND eval_date < DATE '{day}') AS b
    FROM drift_src GROUP BY ALL) WHERE c IS NOT NULL))"""


_METRICS_OUT = """round(route_accuracy, 6) AS route_accuracy, round(escalation_precision, 6) AS escalation_precision,
 round(escalation_recall, 6) AS escalation_recall, round(abstain_rate, 6) AS abstain_rate,
 round(avg_time_to_resolution_seconds, 6) AS avg_time_to_resolution_seconds"""


@register("daily_quality_metrics", f"""
SELECT CAST(eval_date AS VARCHAR) AS eval_date, tenant_id, section, model_variant, sample_size, {_METRICS_OUT}
FROM daily_agg""")
def _q(spark, d):
    return E.daily_quality_metrics(A.evaluation_dataset(spark, d))


@register("ece", "SELECT tenant_id, model_variant, round(ece, 6) AS ece, ece_bins FROM ("
          + ece_sql("eval_keyed", "tenant_id, model_variant") + ")")
def _q(spark, d):
    return E.ece(A.evaluation_dataset(spark, d), ["tenant_id", "model_variant"])


@register("ece_global", "SELECT round(ece, 6) AS ece, ece_bins FROM (" + ece_sql("eval_ds", "") + ")")
def _q(spark, d):
    return E.ece(A.evaluation_dataset(spark, d), [])


@register("metrics_left_ece", f"""
SELECT CAST(eval_date AS VARCHAR) AS eval_date, tenant_id, section, model_variant, sample_size, round(ece, 6) AS ece,
 {_METRICS_OUT} FROM daily_metrics""")
def daily_metrics_query(spark, d):
    return E.metrics_with_ece(A.evaluation_dataset(spark, d))


@register("prediction_events", """
SELECT CAST(eval_date AS VARCHAR) AS eval_date, request_id, tenant_id, section, issue_text, model_variant,
 predicted_decision, predicted_route, round(predicted_route_prob, 6) AS predicted_route_prob,
 round(escalation_prob, 6) AS escalation_prob, round(final_confidence, 6) AS final_confidence,
 model_backend_fallback, source FROM pred_events""")
def prediction_events_query(spark, d):
    return E.prediction_events(A.inference_requests(spark, d), A.inference_results(spark, d), A.shadow_predictions(spark, d))


@register("latest_per_key", """
SELECT request_id, tenant_id, outcome_id, final_decision, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM latest_rev""")
def _q(spark, d):
    o = A.reviewer_outcomes(spark, d).select("request_id", "tenant_id", "outcome_id", "final_decision", "created_at")
    return E.latest_per_key(o, ["request_id", "tenant_id"], [F.col("created_at"), F.col("outcome_id")])


@register("latest_ground_truth", """
SELECT request_id, tenant_id, reviewer_final_decision, reviewer_final_resolution_path, feedback_decision,
 feedback_resolution_path, ground_truth_decision, ground_truth_route, resolution_seconds::BIGINT AS resolution_seconds,
 strftime(ground_truth_created_at, '%Y-%m-%d %H:%M:%S') AS ground_truth_created_at FROM ground_truth""")
def ground_truth_query(spark, d):
    return E.latest_ground_truth(A.reviewer_outcomes(spark, d), A.feedback_events(spark, d))


_DS_OUT = """CAST(eval_date AS VARCHAR) AS eval_date, request_id, tenant_id, section, model_variant, predicted_decision,
 predicted_route, round(predicted_route_prob, 6) AS predicted_route_prob, round(escalation_prob, 6) AS escalation_prob,
 round(final_confidence, 6) AS final_confidence, ground_truth_decision, ground_truth_route, is_route_correct,
 is_escalation_pred, is_escalation_actual, issue_token_count, resolution_seconds::BIGINT AS resolution_seconds, source"""


@register("daily_eval_dataset", f"SELECT {_DS_OUT} FROM logged_ds")
def logged_dataset(spark, d):
    return E.daily_eval_dataset(prediction_events_query(spark, d), ground_truth_query(spark, d))


@register("nullable_correctness", """
SELECT coalesce(CAST(is_route_correct AS VARCHAR), 'null') AS route_correct, is_escalation_pred, is_escalation_actual,
 count(*) AS n FROM logged_ds GROUP BY ALL""")
def _q(spark, d):
    return logged_dataset(spark, d).groupBy(
        F.coalesce(F.col("is_route_correct").cast("string"), F.lit("null")).alias("route_correct"),
        "is_escalation_pred", "is_escalation_actual").agg(F.count(F.lit(1)).alias("n"))


@register("token_count", """
SELECT issue_token_count, count(*) AS n FROM (SELECT
 greatest(1, len(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\\s+')))::BIGINT AS issue_token_count
 FROM documents) GROUP BY ALL""")
def _q(spark, d):
    return A.table(spark, d, "documents").groupBy(
        E.token_count(F.col("text")).alias("issue_token_count")).agg(F.count(F.lit(1)).alias("n"))


@register("section_key", "SELECT section, count(*) AS n FROM eval_keyed GROUP BY ALL")
def _q(spark, d):
    return A.evaluation_dataset(spark, d).groupBy(E.section_key(F.col("section")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@register("derive_shadow_decision", """
SELECT predicted_decision, source, count(*) AS n FROM pred_events WHERE source LIKE 'shadow:%' GROUP BY ALL""")
def _q(spark, d):
    s = A.shadow_predictions(spark, d)
    r = A.inference_requests(spark, d).select("request_id", "tenant_id")
    return s.join(r, ["request_id", "tenant_id"], "left_semi").groupBy(
        E.shadow_decision(F.col("decision"), F.col("escalation_prob")).alias("predicted_decision"),
        F.concat(F.lit("shadow:"), F.col("traffic_bucket")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@register("source_scope", """
SELECT 'shadow_or_canary' AS scope, count(*) AS n FROM eval_ds WHERE source LIKE 'shadow:%'
UNION ALL SELECT 'canary_only', count(*) FROM eval_ds WHERE source = 'shadow:canary'""")
def _q(spark, d):
    ds = A.evaluation_dataset(spark, d)
    frames = [E.in_scope(ds, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("scope"), "n")
              for s in (E.source_scope(0), E.source_scope(25))]
    return frames[0].unionByName(frames[1])


@register("optional_filter", """
SELECT 'none' AS filter, count(*) AS n FROM eval_ds UNION ALL
SELECT 'tenant', count(*) FROM eval_ds WHERE tenant_id = 't1' UNION ALL
SELECT 'section', count(*) FROM eval_ds WHERE section = 's2'""")
def _q(spark, d):
    ds = A.evaluation_dataset(spark, d)
    n = F.count(F.lit(1)).alias("n")
    cases = [("none", "tenant_id", " * "), ("tenant", "tenant_id", "t1"), ("section", "section", "s2")]
    out = [E.optional_filter(ds, F.col(c), raw).agg(n).select(F.lit(name).alias("filter"), "n") for name, c, raw in cases]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _date_windows(col, day: str):
    d = F.lit(day).cast("date")
    return {
        "scorecard": col.between(F.date_sub(d, 27), d),
        "daily": col == d,
        "drift_baseline": (col >= F.date_sub(d, 14)) & (col < d),
        "canary": (col >= F.date_sub(F.date_add(d, 1), 7)) & (col < F.date_add(d, 1)),
        "recalibration": (col >= F.date_sub(d, 30)) & (col < d),
        "rollout": (col >= F.date_sub(d, 13)) & (col <= d),
    }


@register("date_window", f"""
SELECT w AS window_name, count(*) AS n FROM (
 SELECT unnest([CASE WHEN eval_date BETWEEN DATE '{DAY}' - 27 AND DATE '{DAY}' THEN 'scorecard' END,
  CASE WHEN eval_date = DATE '{DAY}' THEN 'daily' END,
  CASE WHEN eval_date >= DATE '{DAY}' - 14 AND eval_date < DATE '{DAY}' THEN 'drift_baseline' END,
  CASE WHEN eval_date >= DATE '{DAY}' - 6 AND eval_date < DATE '{DAY}' + 1 THEN 'canary' END,
  CASE WHEN eval_date >= DATE '{DAY}' - 30 AND eval_date < DATE '{DAY}' THEN 'recalibration' END,
  CASE WHEN eval_date >= DATE '{DAY}' - 13 AND eval_date <= DATE '{DAY}' THEN 'rollout' END]) AS w FROM eval_ds)
WHERE w IS NOT NULL GROUP BY 1""")
def _q(spark, d):
    ds = A.evaluation_dataset(spark, d)
    preds = _date_windows(F.col("eval_date"), DAY)
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in preds.items()]))
    return ds.select(F.explode(names).alias("window_name")).groupBy("window_name").agg(F.count(F.lit(1)).alias("n"))


_CAN = """sample_size, round(route_accuracy, 6) AS route_accuracy, round(escalation_recall, 6) AS escalation_recall,
 round(ece, 6) AS ece, round(abstain_rate, 6) AS abstain_rate"""


def canary_sql(where: str, keys: str) -> str:
    src = f"(SELECT * FROM eval_ds WHERE {where})"
    k = f"{keys}, " if keys else ""
    join = f"LEFT JOIN ({ece_sql(src, keys)}) e USING ({keys})" if keys else f"LEFT JOIN ({ece_sql(src, '')}) e ON TRUE"
    return f"SELECT a.*, e.ece FROM (SELECT {k} {quality_sql(keys)} FROM {src} {('GROUP BY ' + keys) if keys else ''}) a {join}"


@register("canary_window_metrics", f"""SELECT {_CAN} FROM ({canary_sql(
    f"eval_date >= DATE '{DAY}' - 27 AND eval_date <= DATE '{DAY}' AND model_variant='challenger' AND source='shadow:canary'", '')})""")
def _q(spark, d):
    return E.canary_window_metrics(A.evaluation_dataset(spark, d), DAY, 28, 25)


@register("canary_daily_metrics", f"""SELECT CAST(eval_date AS VARCHAR) AS eval_date, {_CAN} FROM ({canary_sql(
    f"eval_date >= DATE '{DAY}' - 89 AND eval_date <= DATE '{DAY}' AND model_variant='challenger' AND source='shadow:canary'",
    'eval_date')})""")
def _q(spark, d):
    return E.canary_daily_metrics(A.evaluation_dataset(spark, d), "1998-03-18", DAY)


@register("drift_metrics", drift_day_sql(DAY))
def drift_query(spark, d, day=DAY):
    ds = A.evaluation_dataset(spark, d)
    recent = ds.filter(F.col("eval_date").between(F.date_sub(F.lit(day).cast("date"), 14), F.lit(day).cast("date")))
    return E.drift_metrics(ds, E.metrics_with_ece(recent), day)


@register("drift_align", """
SELECT c.tenant_id, c.section, round(c.value, 6) AS current_value, round(coalesce(b.value, c.value), 6) AS baseline_value
FROM (SELECT tenant_id, section, avg(final_confidence) AS value FROM eval_keyed WHERE eval_date >= DATE '1998-06-15' GROUP BY ALL) c
LEFT JOIN (SELECT tenant_id, section, avg(final_confidence) AS value FROM eval_keyed
  WHERE eval_date < DATE '1998-06-15' GROUP BY ALL) b USING (tenant_id, section)""")
def _q(spark, d):
    ds = A.evaluation_dataset(spark, d).withColumn("section", E.section_key(F.col("section")))
    def mean(df):
        return df.groupBy("tenant_id", "section").agg(F.avg("final_confidence").alias("value"))
    return E.drift_align(mean(ds.filter("eval_date >= DATE'1998-06-15'")), mean(ds.filter("eval_date < DATE'1998-06-15'")))


@register("drift_alert_counts", f"""
SELECT count(*) AS total_rows, count(*) FILTER (is_alert) AS alert_rows FROM ({drift_day_sql(DAY)})""")
def _q(spark, d):
    return E.drift_alert_counts(drift_query(spark, d), "1998-06-01", DAY)


@register("log_loss", """
SELECT model_variant, count(*) AS sample_size, round(avg(-CASE WHEN is_escalation_actual THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss
FROM (SELECT model_variant, is_escalation_actual, greatest(1e-6, least(1 - 1e-6, escalation_prob)) AS p FROM eval_ds)
GROUP BY 1""")
def _q(spark, d):
    return C.log_loss(A.evaluation_dataset(spark, d), "escalation_prob", "is_escalation_actual", ["model_variant"])


def _samples_sql(prob: str, label: str, lo: str, hi: str) -> str:
    return f"""SELECT {prob} AS prob, {label} AS label, count(*) AS n,
 ln(greatest(1e-6, least(1 - 1e-6, {prob})) / (1 - greatest(1e-6, least(1 - 1e-6, {prob})))) AS lg
 FROM eval_ds WHERE eval_date >= DATE '{lo}' AND eval_date < DATE '{hi}' AND model_variant = 'primary'
  AND {prob} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL"""


_LOSS = "-CASE WHEN label THEN ln(greatest(1e-6, least(1 - 1e-6, cal))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, cal))) END"


def temperature_sql(lo: str, hi: str) -> str:
    return f"""SELECT temperature, loss, sample_size FROM (
 SELECT temperature, sum(n * ({_LOSS})) / sum(n) AS loss, sum(n)::BIGINT AS sample_size FROM (
  SELECT *, 1 / (1 + exp(-(lg / temperature))) AS cal FROM ({_samples_sql('predicted_route_prob', 'is_route_correct', lo, hi)}),
   (SELECT round(0.5 + 0.05 * unnest(range(51)), 10)::DOUBLE AS temperature)) GROUP BY temperature)
 ORDER BY round(loss, 10), temperature LIMIT 1"""


def platt_sql(lo: str, hi: str) -> str:
    return f"""SELECT a, b, loss, sample_size FROM (
 SELECT a, b, sum(n * ({_LOSS})) / sum(n) AS loss, sum(n)::BIGINT AS sample_size FROM (
  SELECT *, 1 / (1 + exp(-(a * lg + b))) AS cal FROM ({_samples_sql('escalation_prob', 'is_escalation_actual', lo, hi)}),
   (SELECT round(0.4 + 0.1 * unnest(range(27)), 10)::DOUBLE AS a),
   (SELECT round(-2.0 + 0.1 * unnest(range(41)), 10)::DOUBLE AS b)) GROUP BY a, b)
 ORDER BY round(loss, 10), a, b LIMIT 1"""


@register("fit_temperature", f"SELECT round(temperature, 6) AS temperature, round(loss, 6) AS loss, sample_size FROM ({temperature_sql('1995-01-01', '2002-01-01')})")
def _q(spark, d):
    return C.fit_temperature(C.calibration_samples(
        A.evaluation_dataset(spark, d), "1995-01-01", "2002-01-01", "primary", "predicted_route_prob", "is_route_correct"))


@register("fit_platt", f"SELECT round(a, 6) AS a, round(b, 6) + 0.0 AS b, round(loss, 6) AS loss, sample_size FROM ({platt_sql('1995-01-01', '2002-01-01')})")
def _q(spark, d):
    return C.fit_platt(C.calibration_samples(
        A.evaluation_dataset(spark, d), "1995-01-01", "2002-01-01", "primary", "escalation_prob", "is_escalation_actual"))


@register("calibration_grid", f"""
SELECT round(temperature, 6) AS temperature, count(*) AS n, round(sum(n * lg / temperature), 6) AS scaled
FROM ({_samples_sql('predicted_route_prob', 'is_route_correct', '1998-01-01', '1999-01-01')}),
 (SELECT round(0.5 + 0.05 * unnest(range(51)), 10)::DOUBLE AS temperature) GROUP BY temperature""")
def _q(spark, d):
    s = C.calibration_samples(A.evaluation_dataset(spark, d), "1998-01-01", "1999-01-01", "primary",
                              "predicted_route_prob", "is_route_correct")
    return C.calibration_grid(s, {"temperature": C.TEMPERATURES}).groupBy("temperature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n") * C.logit(F.col("prob")) / F.col("temperature")).alias("scaled"))


@register("recalibrate", f"""
SELECT 'routing_temperature' AS run_scope, sample_size, round(temperature, 6) AS param_a, NULL::DOUBLE AS param_b,
 round(loss, 6) AS loss, 'primary' AS model_variant FROM ({temperature_sql('1998-05-16', '1998-06-15')})
UNION ALL SELECT 'escalation_platt', sample_size, round(a, 6), round(b, 6) + 0.0, round(loss, 6), 'primary'
FROM ({platt_sql('1998-05-16', '1998-06-15')})""")
def recalibrate_query(spark, d):
    return C.recalibrate(A.evaluation_dataset(spark, d), DAY, 30)
