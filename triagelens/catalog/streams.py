"""Streaming queries: run over the tables with availableNow, read back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import adapters as A
from .. import vocab as V
from ..session import stage, work_path
from ..sources import tables as T
from ..sources.streams import event_stream
from ..streaming import alerts as AL
from ..streaming import audit as AU
from ..streaming import metrics as MX
from ..streaming import slo as SL
from .ctes import with_ctes
from .operations import LOCAL as OPS
from .operations import _changes
from .shape import shaped

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DELAY = "10 minutes"


def register(name: str, sql: str | None = None, digits: int = 6):
    """Means of two-decimal values often end on a 5 at the seventh place; those
    queries compare at nine digits instead."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = with_ctes(sql, {**OPS, **LOCAL})
        return fn

    return wrap


def _windows(length: int, slide: int, keys: str = "service", extra: str = "") -> str:
    """Sliding windows that a watermark of ten minutes has closed."""
    return f"""SELECT make_timestamp(w * 1000000) AS window_end, {keys}, count(*) AS n, count(*) FILTER (status >= 500) AS errors,
 count(*) FILTER (decision = 'abstain') AS abstained, count(*) FILTER (decision = 'escalate') AS escalated, count(*) FILTER (injection_blocked) AS blocked,
 count(*) FILTER (guardrail) AS guarded, sum(token_count)::DOUBLE AS tokens, sum(confidence) AS confidence{extra} FROM (
 SELECT *, (epoch_us(ts) // 1000000 // {slide}) * {slide} - {slide} * k + {length} AS w FROM svc, (SELECT unnest(range({length // slide})) AS k))
 WHERE w * 1000 <= (SELECT epoch_ms(max(ts)) FROM svc) - 600000 GROUP BY ALL"""


def _ratio(num: str, seconds: int) -> str:
    return f"({num} / {seconds}::DOUBLE) / greatest(n / {seconds}::DOUBLE, 0.001::DOUBLE)"


_STAMP = "strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end"
_BOUNDS = V.HISTOGRAM_BUCKETS["http_request_duration_seconds"]


def _quantile(q: float, bounds: list[float] = _BOUNDS) -> str:
    cells = []
    for i, b in enumerate(bounds):
        below, low = (f"b{i - 1}", bounds[i - 1]) if i else ("0", 0.0)
        cells.append(f"WHEN b{i} >= {q} * n THEN {low}::DOUBLE + {b - low}::DOUBLE * coalesce(({q} * n - {below}) / nullif(b{i} - {below}, 0)::DOUBLE, 0)")
    return "CASE " + " ".join(cells) + f" ELSE {bounds[-1]}::DOUBLE END"


_ANSWER_SUMS = ", ".join(f"sum({column}) AS {c}_sum, count({column}) AS {c}_n" for c, column in MX.ANSWERS.items())


def _trailing() -> str:
    wanted = {86400: ["n", "escalated", "tokens", "confidence"], 600: ["guarded"], 300: ["n", "errors", *[f"b{i}" for i in range(len(_BOUNDS))], "breaker"],
              3600: ["n", "abstained", "escalated", "blocked", "tokens", "confidence", *[f"{c}_{x}" for c in MX.ANSWERS for x in ("sum", "n")]]}
    return ", ".join(f"coalesce(sum({c}) FILTER (k < {s // 300}), 0) AS {c}_{s}" for s, columns in wanted.items() for c in columns)


def _part(c: str, s: int, n: str = "n") -> str:
    return f"(({c}_{s} / {s}::DOUBLE) / greatest({n}_{s} / {s}::DOUBLE, 0.001::DOUBLE))"


def _five(q: float) -> str:
    text = re.sub(r"\bb(\d+)\b", r"b\1_300", _quantile(q))
    return f"CASE WHEN n_300 > 0 THEN {re.sub(r'\bn\b', 'n_300', text)} END"


_METRIC = "round(CASE r.metric " + " ".join(f"WHEN '{m}' THEN h.{m}" for m in dict.fromkeys(r[1] for r in AL.RULES)) + " END, 9)"

LOCAL: dict[str, str] = {
    "win_hour": _windows(3600, 300),
    "hour_rates": f"""SELECT window_end, service, n, {_ratio('errors', 3600)} AS error_rate, {_ratio('abstained', 3600)} AS abstain_rate, {_ratio('escalated', 3600)} AS escalation_rate,
  {_ratio('blocked', 3600)} AS injection_block_rate, guarded / 3600::DOUBLE AS guardrail_rate, {_ratio('tokens', 3600)} AS token_mean, {_ratio('confidence', 3600)} AS confidence_mean FROM win_hour""",
    "p5": f"""SELECT service, (epoch_us(ts) // 1000000 // 300) * 300 + 300 AS e, count(*) AS n, count(*) FILTER (status >= 500) AS errors,
  count(*) FILTER (decision = 'abstain') AS abstained, count(*) FILTER (decision = 'escalate') AS escalated, count(*) FILTER (injection_blocked) AS blocked,
  count(*) FILTER (guardrail) AS guarded, sum(token_count)::DOUBLE AS tokens, sum(confidence) AS confidence, {_ANSWER_SUMS},
  {', '.join(f"count(*) FILTER (duration_seconds <= {b}::DOUBLE) AS b{i}" for i, b in enumerate(_BOUNDS))}, arg_max(breaker_state, (ts, event_id)) AS breaker FROM svc GROUP BY ALL""",
    "trail": f"""SELECT service, tick, {_trailing()} FROM (SELECT *, e + 300 * k AS tick FROM p5, (SELECT unnest(range(288)) AS k) WHERE e * 1000 <= (SELECT epoch_ms(max(ts)) FROM svc) - 600000)
  WHERE tick * 1000 <= (SELECT epoch_ms(max(ts)) FROM svc) - 600000 GROUP BY 1, 2""",
    "metric_rows": f"""SELECT make_timestamp(tick * 1000000) AS window_end, service, n_300 AS n, {_part('errors', 300)} AS error_rate, {_part('errors', 300)} AS model_error_rate,
  {_five(0.5)} AS p50, {_five(0.95)} AS p95, {_five(0.99)} AS p99, n_300 / 300::DOUBLE AS throughput_5m, n_3600 / 3600::DOUBLE AS throughput_1h,
  CASE WHEN n_300 / 300::DOUBLE < 0.1 AND n_3600 / 3600::DOUBLE > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS throughput_collapse,
  {_part('abstained', 3600)} AS abstain_rate, {_part('escalated', 3600)} AS escalation_rate, {_part('blocked', 3600)} AS injection_block_rate, guarded_600 / 600::DOUBLE AS guardrail_rate,
  abs({_part('tokens', 3600)} - {_part('tokens', 86400)}) / greatest({_part('tokens', 86400)}, 1.0::DOUBLE) AS input_drift,
  abs({_part('confidence', 3600)} - {_part('confidence', 86400)}) AS confidence_drift, abs({_part('escalated', 3600)} - {_part('escalated', 86400)}) AS outcome_drift,
  {', '.join(f"CASE WHEN {c}_n_3600 > 0 THEN {_part(f'{c}_sum', 3600, f'{c}_n')} END AS {c}" for c in MX.ANSWERS)}, breaker_300::DOUBLE AS breaker_state FROM trail""",
    "rule_rows": "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', '{m}', '{op}', {lim}::DOUBLE, {hold}, '{sev}', '{slo}', '{own}')" for n, m, op, lim, hold, sev, slo, own in AL.RULES) + ") r(alertname, metric, op, lim, hold, severity, slo, owner)",
    "breaches": f"""SELECT h.window_end, h.service, r.* FROM metric_rows h JOIN rule_rows r
  ON (r.alertname NOT LIKE 'DecisionApi%' OR h.service = 'decision-api') AND (r.alertname NOT LIKE 'ModelServing%' OR h.service = 'decision-model-serving')
  WHERE CASE WHEN r.op = '>' THEN {_METRIC} > r.lim ELSE {_METRIC} < r.lim END""",
    "fired": """SELECT *, epoch(window_end)::BIGINT - min(epoch(window_end)::BIGINT) OVER (PARTITION BY alertname, service, island) AS active_seconds FROM (
  SELECT *, epoch(window_end)::BIGINT - 300 * row_number() OVER (PARTITION BY alertname, service ORDER BY window_end) AS island FROM breaches)""",
}


def metric_table(spark, d):
    """Every metric at every step that the stream of partial sums has closed."""
    sums = SL.run_available(MX.step_sums(_events(spark, d), DELAY), "partials")
    closed = A.table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {DELAY}")).alias("closed"))
    return MX.metric_rows(sums).where(F.col("window_end") <= closed.scalar())


def in_slices(spark, df, time: str, slices: int, late_seconds: int = 0) -> str:
    """Write ``df`` as files of consecutive time ranges; with ``late_seconds`` half of the rows come that much later."""
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    ends = df.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    late = F.when(F.pmod(F.xxhash64(time), F.lit(2)) == 0, late_seconds).otherwise(0)
    part = F.floor((t + late - F.lit(ends["a"])) * slices / F.lit(max(1, ends["b"] - ends["a"] + 1)))
    path = work_path(spark, "slices")
    for k in range(slices):
        df.where(F.least(part, F.lit(slices - 1)) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def _events(spark, d):
    return A.service_events_from(event_stream(spark, d, "events.parquet"))


@register("st_error_rate", f"""SELECT {_STAMP}, service, n, round({_ratio('errors', 300)}, 6) AS error_rate, round(1 - {_ratio('errors', 300)}, 6) AS availability,
 round(n / 300::DOUBLE, 6) AS throughput_rps FROM ({_windows(300, 30)})""")
def _q(spark, d):
    t = SL.run_available(SL.window_sums(_events(spark, d), "5 minutes", "30 seconds", watermark=DELAY), "error-rate")
    return SL.rates(t, 300).select("window_end", "service", "n", "error_rate", "availability", "throughput_rps")


@register("st_latency_quantiles", f"""SELECT {_STAMP}, service, stage, n, round({_quantile(0.5)}, 6) AS p50, round({_quantile(0.95)}, 6) AS p95, round({_quantile(0.99)}, 6) AS p99
FROM ({_windows(3600, 900, 'service, stage', ''.join(f", count(*) FILTER (duration_seconds <= {b}::DOUBLE) AS b{i}" for i, b in enumerate(_BOUNDS)))})""")
def _q(spark, d):
    return SL.run_available(SL.latency_quantiles(_events(spark, d), "1 hour", "15 minutes", ["service", "stage"], DELAY), "latency")


def _quantiles_sql(histogram: str, keys: str) -> str:
    """p50, p95 and p99 over five minutes from the buckets of a histogram."""
    bounds = V.HISTOGRAM_BUCKETS[histogram]
    counts = "".join(f", count(*) FILTER (duration_seconds <= {b}::DOUBLE) AS b{i}" for i, b in enumerate(bounds))
    shown = ", ".join(f"round({_quantile(q, bounds)}, 6) AS {name}" for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    return f"SELECT {_STAMP}, {keys}, n, {shown} FROM ({_windows(300, 60, keys, counts)})"


@register("st_stage_latency", _quantiles_sql("pipeline_stage_duration_seconds", "service, stage"))
def _q(spark, d):
    return SL.run_available(SL.latency_quantiles(
        _events(spark, d), "5 minutes", "1 minute", ["service", "stage"], DELAY, "pipeline_stage_duration_seconds"), "stage-latency")


@register("st_pipeline_latency", _quantiles_sql("pipeline_total_duration_seconds", "service"))
def _q(spark, d):
    return SL.run_available(SL.latency_quantiles(
        _events(spark, d), "5 minutes", "1 minute", ["service"], DELAY, "pipeline_total_duration_seconds"), "pipeline-latency")


_HOUR = ["error_rate", "abstain_rate", "escalation_rate", "injection_block_rate", "guardrail_rate", "token_mean", "confidence_mean"]


@register("st_outcome_rates", f"SELECT {_STAMP}, service, n, " + ", ".join(f"round({c}, 9) AS {c}" for c in _HOUR) + " FROM hour_rates", digits=9)
def hour_rates(spark, d):
    t = SL.run_available(SL.window_sums(_events(spark, d), "1 hour", "5 minutes", watermark=DELAY), "outcomes")
    return SL.rates(t, 3600).select("window_end", "service", "n", *_HOUR)


def _drift_side(seconds: int, tag: str) -> str:
    means = ", ".join(f"{_ratio(c, seconds)} AS {c}_{tag}" for c in ("tokens", "confidence", "escalated"))
    return f"SELECT window_end, service, {means} FROM ({_windows(seconds, 300)})"


@register("st_input_confidence_drift", f"""SELECT {_STAMP}, service, round(abs(tokens_s - tokens_l) / greatest(tokens_l, 1.0::DOUBLE), 9) AS input_drift,
 round(abs(confidence_s - confidence_l), 9) AS confidence_drift, round(abs(escalated_s - escalated_l), 9) AS outcome_drift
FROM ({_drift_side(3600, 's')}) JOIN ({_drift_side(86400, 'l')}) USING (window_end, service)""", digits=9)
def _q(spark, d):
    # four micro-batches, one for each file
    events = event_stream(spark, in_slices(spark, A.table(spark, d, "events"), "ts", 4), max_files=1)
    return SL.run_available(MX.drift_stream(A.service_events_from(events), DELAY), "drift")


_HOURLY = list(MX.ANSWERS)[:4]


@register("st_rag_quality_means", f"SELECT {_STAMP}, service, {', '.join(f'round({c}, 9) AS {c}' for c in _HOURLY)} FROM metric_rows WHERE coalesce({', '.join(_HOURLY)}) IS NOT NULL", digits=9)
def _q(spark, d):
    return metric_table(spark, d).select("window_end", "service", *_HOURLY).dropna("all", subset=_HOURLY)


@register("st_cost_mean", f"SELECT {_STAMP}, service, round(cost_per_request, 9) AS cost_per_request FROM metric_rows WHERE cost_per_request IS NOT NULL", digits=9)
def _q(spark, d):
    return metric_table(spark, d).select("window_end", "service", "cost_per_request").dropna()


_FIRED = "strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, alertname, service, active_seconds"


@register("st_alerts", f"SELECT {_FIRED}, severity, slo, owner FROM fired WHERE active_seconds >= hold")
def _q(spark, d):
    return AL.firing(AL.evaluations(metric_table(spark, d)), 300).select("window_end", "alertname", "service", "active_seconds", "severity", "slo", "owner")


_LATE = 6 * 3600


@register("st_alerts_stateful", f"SELECT {_FIRED} FROM fired WHERE active_seconds >= hold AND epoch(window_end) < (SELECT max(epoch(window_end)) FROM breaches) - {_LATE}")
def _q(spark, d):
    # four files, in which half of the evaluations come two hours late
    path = in_slices(spark, AL.evaluations(metric_table(spark, d)).where("breached"), "window_end", 4, 7200)
    return SL.run_available(AL.firing_stream(event_stream(spark, path, max_files=1), 300, f"{_LATE} seconds"), "firing")


@register("st_alert_history", """SELECT alertname, service, CAST(CAST(window_end AS DATE) AS VARCHAR) AS day, count(*) AS evaluations FROM fired WHERE active_seconds >= hold GROUP BY ALL""")
def _q(spark, d):
    return AL.alert_history(AL.firing(AL.evaluations(metric_table(spark, d)), 300))


@register("st_alert_grouping", """WITH g AS (SELECT strftime(make_timestamp((epoch(window_end)::BIGINT // 300) * 300 * 1000000), '%Y-%m-%d %H:%M:%S') AS group_start, alertname, severity, owner, slo,
 count(*) AS alerts FROM fired WHERE active_seconds >= hold GROUP BY ALL)
SELECT *, CASE WHEN severity = 'critical' THEN 'ops-pager-critical|' ELSE '' END || CASE owner WHEN 'model_oncall' THEN 'model-oncall-warning' ELSE 'platform-oncall-warning' END AS receivers
FROM g WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM g c WHERE c.severity = 'critical' AND c.alertname = g.alertname AND c.owner = g.owner AND c.group_start = g.group_start))""")
def _q(spark, d):
    return AL.alert_groups(AL.firing(AL.evaluations(metric_table(spark, d)), 300))


# -- audits -----------------------------------------------------------------

_TLIMIT, _ULIMIT, _SPAN = 15, 2, 21600


@register("st_over_limit", f"""SELECT strftime(make_timestamp(w * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end, tenant_id, count(*) AS requests FROM (
 SELECT *, (epoch_us(ts) // 1000000 // {_SPAN}) * {_SPAN} + {_SPAN} AS w FROM svc) WHERE w * 1000 <= (SELECT epoch_ms(max(ts)) FROM svc) - 600000 GROUP BY 1, 2 HAVING count(*) > {_TLIMIT}""")
def _q(spark, d):
    return SL.run_available(AU.over_limit(_events(spark, d), ["tenant_id"], _TLIMIT, _SPAN, DELAY), "over-limit")


def _bucket_sql(source: str, key: str, limit: int) -> str:
    refill = int(_SPAN * 1_000_000 / limit)
    expiry = (-(-limit * refill // 1_000_000) + 1) * 1_000_000
    return f"""o AS (SELECT *, {key} AS k, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {source}),
 r AS (SELECT k, rn, event_id, us, us AS last_us, us AS seen, {limit - 1}::BIGINT AS tokens, TRUE AS allowed FROM o WHERE rn = 1 UNION ALL
  SELECT k, rn, event_id, us, last_us + back * {refill}, us, greatest(t - 1, 0), t > 0 FROM (
   SELECT k, rn, event_id, us, back, last_us, least({limit}, tokens + back) AS t FROM (
    SELECT o.k, o.rn, o.event_id, o.us, CASE WHEN o.us - r.seen >= {expiry} THEN o.us ELSE r.last_us END AS last_us,
     CASE WHEN o.us - r.seen >= {expiry} THEN {limit} ELSE r.tokens END AS tokens,
     CASE WHEN o.us - r.seen >= {expiry} THEN 0 ELSE (o.us - r.last_us) // {refill} END AS back
    FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)))"""


@register("st_throttle_audit", f"""WITH RECURSIVE {_bucket_sql('svc', 'tenant_id', _TLIMIT)},
 {_bucket_sql('(SELECT svc.* FROM svc JOIN r ON r.event_id = svc.event_id WHERE r.allowed)', "tenant_id || '/' || user_id", _ULIMIT)
   .replace('o AS (', 'o2 AS (', 1).replace(' r AS (', ' r2 AS (').replace('FROM o WHERE', 'FROM o2 WHERE').replace('FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1', 'FROM r2 r JOIN o2 o ON o.k = r.k AND o.rn = r.rn + 1')}
SELECT 'tenant' AS scope, k AS tenant_id, 'decide' AS action, count(*) AS refused FROM r WHERE NOT allowed GROUP BY 2
UNION ALL SELECT 'user', split_part(k, '/', 1), 'decide', count(*) FROM r2 WHERE NOT allowed GROUP BY 2""")
def _q(spark, d):
    e = A.service_events(spark, d).select("event_id", "ts", "tenant_id", "user_id", F.lit("decide").alias("action"))
    return AU.throttle_audit(e, _TLIMIT, _ULIMIT, _SPAN)


LOCAL["outc"] = "SELECT stage || '-' || service AS target, ts, event_id, (duration_seconds > 0.35) AS failed FROM svc"
LOCAL["outc_runs"] = """SELECT *, row_number() OVER (PARTITION BY target, island ORDER BY ts, event_id) AS pos FROM (
 SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY target ORDER BY ts, event_id) AS island FROM outc) WHERE failed"""


def _outcomes(e):
    return e.select(F.concat_ws("-", "stage", "service").alias("target"), "ts", "event_id", (F.col("duration_seconds") > 0.35).alias("failed"))


@register("st_failure_runs", """SELECT target, count(*) AS failures, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended_at
FROM outc_runs GROUP BY target, island HAVING count(*) >= 5""")
def _q(spark, d):
    return AU.failure_runs(_outcomes(A.service_events(spark, d)), "target")


@register("st_failure_trips", "SELECT target, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM outc_runs WHERE pos = 5")
def _q(spark, d):
    return SL.run_available(AU.failure_runs_stream(_outcomes(_events(spark, d)), "target"), "trips")


@register("st_dedupe_requests", "SELECT tenant_id, request_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, user_id || '-' || stage AS request_id FROM svc) GROUP BY ALL")
def _q(spark, d):
    e = _events(spark, d).withColumn("request_id", F.concat_ws("-", "user_id", "stage")).select("tenant_id", "request_id", "ts")
    return SL.run_available(AU.dedupe_requests(e), "dedupe").groupBy("tenant_id", "request_id").agg(F.count(F.lit(1)).alias("n"))


_DEADLINE, _IDLE, _SETTLE = 10 * 86400, 30 * 86400, 5 * 86400
LOCAL |= {
    "settled": f"""SELECT handoff_id, tenant_id, change_id, queue_status, changed_at, epoch(changed_at)::BIGINT AS t, (SELECT max(epoch(changed_at))::BIGINT FROM changes) - {_SETTLE} AS now FROM changes""",
    "case_marks": f"""SELECT *, lag(t) OVER h AS before, coalesce(lag(queue_status) OVER h IN ('resolved', 'closed') OR t - lag(t) OVER h > {_IDLE}, TRUE) AS begins
  FROM settled WHERE t < now WINDOW h AS (PARTITION BY handoff_id ORDER BY changed_at, change_id)""",
    "case_changes": "SELECT *, count(*) FILTER (begins) OVER (PARTITION BY handoff_id ORDER BY changed_at, change_id) AS case_no FROM case_marks",
    "handoff_cases": f"""SELECT handoff_id, case_no, min(t) AS opened, max(t) AS last, max(now) AS now, arg_max(tenant_id, (t, change_id)) AS tenant_id,
  arg_max(queue_status, (t, change_id)) AS queue_status, bool_or(queue_status IN ('resolved', 'closed')) AS done FROM case_changes GROUP BY ALL""",
    "overdue_at": f"""SELECT c.handoff_id, c.case_no, c.opened, arg_max(x.queue_status, (x.t, x.change_id)) AS queue_status, arg_max(x.tenant_id, (x.t, x.change_id)) AS tenant_id
  FROM handoff_cases c JOIN case_changes x ON x.handoff_id = c.handoff_id AND x.case_no = c.case_no AND x.t <= c.opened + {_DEADLINE}
  WHERE c.opened + {_DEADLINE} < c.now AND NOT (c.done AND c.last <= c.opened + {_DEADLINE}) GROUP BY ALL""",
}


def _case(source: str, event: str, at: str, where: str) -> str:
    return f"""SELECT handoff_id, tenant_id, '{event}' AS event, queue_status, strftime(make_timestamp(opened * 1000000), '%Y-%m-%d %H:%M:%S') AS opened_at,
 strftime(make_timestamp(({at}) * 1000000), '%Y-%m-%d %H:%M:%S') AS at, ({at}) - opened AS seconds FROM {source} WHERE {where}"""


def _changes_stream(spark, d):
    # four files, in which half of the changes come two days late
    return event_stream(spark, in_slices(spark, _changes(spark, d), "changed_at", 4, 2 * 86400), max_files=1)


@register("st_handoff_state", " UNION ALL ".join([
    _case("handoff_cases", "resolved", "last", "done"), _case("overdue_at", "overdue", f"opened + {_DEADLINE}", "TRUE"),
    _case("handoff_cases", "expired", f"last + {_IDLE}", f"NOT done AND last + {_IDLE} < now OR NOT done AND EXISTS (SELECT 1 FROM handoff_cases n WHERE n.handoff_id = handoff_cases.handoff_id AND n.case_no = handoff_cases.case_no + 1)")]))
def _q(spark, d):
    return SL.run_available(AU.handoff_cases(_changes_stream(spark, d), f"{_SETTLE} seconds", _DEADLINE, _IDLE), "cases")


@register("src_event_stream", "SELECT service, count(*) AS n, round(sum(duration_seconds), 6) AS total FROM svc GROUP BY 1")
def _q(spark, d):
    out = SL.run_available(_events(spark, d).select("service", "event_id", "duration_seconds"), "events")
    return out.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("total"))
