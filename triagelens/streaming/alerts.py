"""Alert rules over metric rows: breach, hold time, history, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Alert, metric, comparison, threshold, hold seconds, severity, slo, owner.
RULES: list[tuple[str, str, str, float, int, str, str, str]] = [
    ("DecisionApiHighErrorRate", "error_rate", ">", 0.01, 600, "critical", "availability", "platform_oncall"),
    ("DecisionApiHighLatencyP95", "p95", ">", 1.0, 900, "warning", "latency", "platform_oncall"),
    ("DecisionApiHighLatencyP99", "p99", ">", 2.0, 600, "critical", "latency", "platform_oncall"),
    ("DecisionApiLowThroughput", "throughput_collapse", ">", 0.5, 600, "warning", "availability", "platform_oncall"),
    ("ModelServingHighErrorRate", "model_error_rate", ">", 0.01, 600, "warning", "availability", "model_oncall"),
    ("DecisionApiInputDriftDetected", "input_drift", ">", 0.30, 1800, "warning", "data-quality", "model_oncall"),
    ("DecisionApiConfidenceDriftDetected", "confidence_drift", ">", 0.12, 1800, "warning", "data-quality", "model_oncall"),
    ("DecisionApiOutcomeDriftDetected", "outcome_drift", ">", 0.10, 1800, "warning", "data-quality", "model_oncall"),
    ("DecisionApiGuardrailFallbackSpike", "guardrail_rate", ">", 0.05, 900, "critical", "reliability", "model_oncall"),
    ("DecisionApiHighHallucinationRate", "hallucination", ">", 0.35, 900, "critical", "quality", "model_oncall"),
    ("DecisionApiLowFaithfulness", "faithfulness", "<", 0.5, 900, "warning", "quality", "model_oncall"),
    ("DecisionApiHighAbstainRate", "abstain_rate", ">", 0.35, 1800, "warning", "coverage", "model_oncall"),
    ("DecisionApiHighInjectionRate", "injection_block_rate", ">", 0.10, 900, "critical", "security", "platform_oncall"),
    ("CircuitBreakerOpen", "breaker_state", ">", 0.0, 120, "critical", "reliability", "platform_oncall"),
]


#: The service whose metrics a rule reads, by the start of its name; other rules read all.
SERVICE_OF = {"DecisionApi": "decision-api", "ModelServing": "decision-model-serving"}


def evaluations(metrics: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """One row per rule and metric row of its service: breached or not. Narrow."""
    have = set(metrics.columns)
    cells = []
    for name, m, op, limit, hold, sev, slo, owner in rules or RULES:
        if m not in have:
            continue
        # sums in another order must not decide at the limit itself
        value = F.round(F.col(m), 9)
        cell = F.struct(
            F.lit(name).alias("alertname"), F.coalesce(value > limit if op == ">" else value < limit, F.lit(False)).alias("breached"),
            F.lit(hold).alias("hold_seconds"), F.lit(sev).alias("severity"), F.lit(slo).alias("slo"), F.lit(owner).alias("owner"))
        service = next((s for start, s in SERVICE_OF.items() if name.startswith(start)), None)
        cells.append(cell if service is None else F.when(F.col("service") == service, cell))
    return metrics.select("window_end", "service", F.inline(F.array_compact(F.array(*cells))))


def firing(evals: DataFrame, step_seconds: int) -> DataFrame:
    """Breaches that lasted their hold time.

    A run of breaches is broken by a good or a missing evaluation. Rows per
    series are evaluation steps, so a series grows with time only.
    """
    w = Window.partitionBy("alertname", "service").orderBy("window_end")
    t = F.unix_timestamp("window_end")
    bad = evals.filter("breached")
    starts = bad.withColumn("_new", F.coalesce(t - F.lag(t).over(w) > step_seconds, F.lit(True)))
    run = starts.withColumn("_since", F.last(F.when(F.col("_new"), t), ignorenulls=True).over(w))
    return run.withColumn("active_seconds", t - F.col("_since")).filter(F.col("active_seconds") >= F.col("hold_seconds")).drop("_new", "_since", "breached")


def alert_history(fired: DataFrame) -> DataFrame:
    """Did the alert fire on a day, per service?"""
    return fired.groupBy("alertname", "service", F.to_date("window_end").alias("day")).agg(F.count(F.lit(1)).alias("evaluations"))


def alert_groups(fired: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """Notification groups per interval with receivers.

    A critical alert goes to the pager and on to its owner; it silences the
    warning of the same name and owner in the same interval.
    """
    g = fired.groupBy(F.window("window_end", interval)["start"].alias("group_start"), "alertname", "severity", "owner", "slo").agg(
        F.count(F.lit(1)).alias("alerts"))
    critical = g.filter(F.col("severity") == "critical").select("group_start", "alertname", "owner").distinct()
    quiet = g.filter(F.col("severity") == "warning").join(critical, ["group_start", "alertname", "owner"], "left_anti")
    kept = g.filter(F.col("severity") != "warning").unionByName(quiet)
    owner = F.when(F.col("owner") == "model_oncall", "model-oncall-warning").when(F.col("owner") == "platform_oncall", "platform-oncall-warning")
    receivers = F.array_compact(F.array(F.when(F.col("severity") == "critical", F.lit("ops-pager-critical")), owner))
    return kept.withColumn("receivers", F.when(F.size(receivers) == 0, F.array(F.lit("ops-ticket"))).otherwise(receivers))


# -- streaming twin ---------------------------------------------------------


def firing_stream(evals: DataFrame, step_seconds: int, watermark: str) -> DataFrame:
    """``firing`` on a stream of evaluations, in the order of event time.

    Only breaches reach the state, as a good evaluation breaks a run like a missing one. They wait
    in the state of their series until the watermark has passed them; a timer then takes the
    waiting ones in order. So rows may come in any order and any split into batches, as long as
    they are no later than ``watermark``. The state of a series is the run's start and last step
    and the breaches that wait.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    out = "alertname string, service string, window_end timestamp, active_seconds bigint"

    class Hold(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.run = handle.getValueState("run", "since bigint, last bigint")
            self.waiting = handle.getListState("waiting", "at bigint, hold bigint")

        def handleInputRows(self, key, rows, timerValues):
            new = [(int(end.timestamp()), int(hold)) for frame in rows for end, hold in zip(frame["window_end"], frame["hold_seconds"])]
            self.waiting.appendList(new)
            # a timer may fire when the watermark is at its time; one millisecond later that time has passed
            self.handle.registerTimer(min(new)[0] * 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # all that the watermark has passed is taken at once; later timers of the batch find nothing
            passed = timerValues.getCurrentWatermarkInMs()
            rows = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
            due, rest = [r for r in rows if r[0] * 1000 < passed], [r for r in rows if r[0] * 1000 >= passed]
            since, last = self.run.get() if self.run.exists() else (-1, -1)
            hits = []
            for now, hold in due:
                if since < 0 or now - last > step_seconds:
                    since = now
                last = now
                if now - since >= hold:
                    hits.append((key[0], key[1], pd.Timestamp(now, unit="s"), now - since))
            if due:
                self.run.update((since, last))
                self.waiting.clear()
                if rest:
                    self.waiting.put(rest)
            if rest:
                self.handle.registerTimer(rest[0][0] * 1000 + 1)
            yield pd.DataFrame(hits, columns=["alertname", "service", "window_end", "active_seconds"])

        def close(self):
            pass

    timed = evals.where("breached").select("alertname", "service", "window_end", "hold_seconds").withWatermark("window_end", watermark)
    return timed.groupBy("alertname", "service").transformWithStateInPandas(
        statefulProcessor=Hold(), outputStructType=out, outputMode="Append", timeMode="EventTime")
