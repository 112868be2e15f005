"""Canary promotion, rollout validation and readiness checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import source_scope

# The rollout ladder, required stages, watched alerts, gates.
STAGES = [0, 5, 25, 50, 100]
REQUIRED_STAGES = [5, 25, 50, 100]
SLO_ALERTS = ["DecisionApiHighErrorRate", "DecisionApiHighLatencyP95", "ModelServingHighErrorRate"]
CONTROL_MAX_AGE_DAYS = {
    "incident_endpoint_verification": 30,
    "oncall_schedule_audit": 30,
    "secret_rotation": 90,
    "access_review": 90,
    "load_test": 30,
    "soak_test": 30,
    "failure_test": 30,
}
SECURITY_CONTROL_MAX_AGE_DAYS = {
    "secret_rotation": 90,
    "access_review": 90,
    "oncall_schedule_audit": 30,
    "incident_endpoint_verification": 30,
}


@dataclass(frozen=True)
class Gates:
    min_route_accuracy: float = 0.75
    min_escalation_recall: float = 0.70
    max_ece: float = 0.15
    max_abstain_rate: float = 0.35
    min_sample_size: int = 200


# -- ladder -----------------------------------------------------------------


def _clamped(percent: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), percent.cast("int")))


def stage_next(percent: Column) -> Column:
    ladder = F.array(*[F.lit(s) for s in STAGES])
    p = _clamped(percent)
    return F.coalesce(F.array_min(F.filter(ladder, lambda s: s > p)), p)


def stage_prev(percent: Column) -> Column:
    ladder = F.array(*[F.lit(s) for s in STAGES])
    p = _clamped(percent)
    return F.coalesce(F.array_max(F.filter(ladder, lambda s: s < p)), F.lit(0))


# -- reasons ----------------------------------------------------------------


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def window_reasons(g: Gates, scope: str) -> Column:
    """Blocking reasons of one canary window, in report order."""
    n, acc, rec, e, ab = (F.col(c) for c in ("sample_size", "route_accuracy", "escalation_recall", "ece", "abstain_rate"))
    empty = "no_canary_samples" if scope == "canary_only" else "no_challenger_samples"
    return _reasons(
        (n <= 0, empty),
        (n < g.min_sample_size, "sample_size_below_gate"),
        (acc.isNull(), "missing_route_accuracy"),
        (acc < g.min_route_accuracy, "route_accuracy_below_gate"),
        (rec.isNull(), "missing_escalation_recall"),
        (rec < g.min_escalation_recall, "escalation_recall_below_gate"),
        (e.isNull(), "missing_ece"),
        (e > g.max_ece, "ece_above_gate"),
        (ab > g.max_abstain_rate, "abstain_rate_above_gate"),
    )


def daily_gate(daily: DataFrame, g: Gates, min_daily_samples: int) -> DataFrame:
    """Pass flag and reasons per day; a missing metric counts as below its gate."""
    floor = max(int(min_daily_samples), int(g.min_sample_size))
    acc, rec, e = F.col("route_accuracy"), F.col("escalation_recall"), F.col("ece")
    reasons = _reasons(
        (F.col("sample_size") < floor, "sample_size_below_min_daily"),
        (acc.isNull() | (acc < g.min_route_accuracy), "route_accuracy_below_gate"),
        (rec.isNull() | (rec < g.min_escalation_recall), "escalation_recall_below_gate"),
        (e.isNull() | (e > g.max_ece), "ece_above_gate"),
        (F.col("abstain_rate") > g.max_abstain_rate, "abstain_rate_above_gate"),
    )
    return daily.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def promote_canary(
    window_metrics: DataFrame, g: Gates, eval_date: str, current_percent: int,
    lookback_days: int = 7, apply: bool = False, rollback_on_fail: bool = False,
) -> DataFrame:
    """Rollout event for one window: gate result, action and target percent."""
    scope = source_scope(current_percent)
    cur = F.lit(int(current_percent))
    passed = F.size("blocking_reasons") == 0
    target = F.when(passed, stage_next(cur)).when(
        F.lit(rollback_on_fail) & (cur > 0), stage_prev(cur)).otherwise(cur)
    return (
        window_metrics.withColumn("blocking_reasons", window_reasons(g, scope))
        .withColumn("target_percent", target)
        .select(
            F.lit(eval_date).cast("date").alias("eval_date"),
            F.lit(int(lookback_days)).alias("lookback_days"),
            F.lit("challenger").alias("model_variant"),
            F.when(passed, "pass").otherwise("blocked").alias("gate_result"),
            F.when(F.col("target_percent") > cur, "promote")
            .when(F.col("target_percent") < cur, "rollback").otherwise("hold").alias("action"),
            (F.lit(apply) & (F.col("target_percent") != cur)).alias("apply_change"),
            F.lit(rollback_on_fail).alias("rollback_on_fail"),
            cur.alias("current_percent"), "target_percent",
            "sample_size", "route_accuracy", "escalation_recall", "ece", "abstain_rate",
            F.lit(scope).alias("source_scope"), "blocking_reasons",
        )
    )


# -- rollout validation -----------------------------------------------------


def stable_days(daily_status: DataFrame, end_date: str, max_days: int) -> DataFrame:
    """Length of the unbroken run of passing days that ends at ``end_date``.

    The run breaks at the newest day of the window that failed or is missing;
    a calendar of at most ``max_days`` rows carries the answer.
    """
    spark = daily_status.sparkSession
    span = max(1, int(max_days))
    end = F.lit(end_date).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, span - 1), end)).alias("eval_date"))
    good = daily_status.filter("passed").select("eval_date").distinct()
    broken = calendar.join(good, "eval_date", "left_anti")
    return broken.agg(F.least(F.lit(span), F.coalesce(F.datediff(end, F.max("eval_date")), F.lit(span))).alias("stable_days"))


def stage_progression(events: DataFrame, end_date: str, required: list[int] | None = None) -> DataFrame:
    """Did applied promotions reach the required stages in order?

    Each stage's arrival is the first promotion to it after the previous
    stage's arrival: a chain of plain minima linked by scalar subqueries, so
    the event log is never ordered or gathered as a whole.
    """
    steps = required or REQUIRED_STAGES
    upto = events.filter(F.col("eval_date") <= F.lit(end_date).cast("date"))
    promoted = F.col("apply_change") & (F.col("action") == "promote")
    at = F.struct("created_at", "event_id")
    arrivals, previous = [], None
    for step in steps:
        hits = upto.filter(promoted & (F.col("target_percent") == step))
        if previous is not None:
            hits = hits.filter(at > previous.scalar())
        previous = hits.agg(F.min(at).alias("arrival"))
        arrivals.append(previous)

    def first_day(condition: Column, pick) -> Column:
        return pick("eval_date", F.when(promoted & condition, at))

    summary = upto.agg(
        F.lit(0).cast("bigint").alias("stages_reached"),
        first_day(F.col("target_percent") >= 5, F.min_by).alias("canary_started"),
        first_day(F.col("target_percent") >= 100, F.max_by).alias("full_rollout"),
        F.count_if(F.col("apply_change") & (F.col("action") == "rollback")).alias("rollbacks"),
    )
    for one in arrivals:
        summary = summary.unionByName(
            one.select(F.col("arrival").isNotNull().cast("bigint").alias("stages_reached")), allowMissingColumns=True)
    return summary.agg(
        F.sum("stages_reached").alias("stages_reached"), F.max("canary_started").alias("canary_started"),
        F.max("full_rollout").alias("full_rollout"), F.max("rollbacks").alias("rollbacks"),
    ).withColumn("complete", F.col("stages_reached") == len(steps))


def latest_calibration(runs: DataFrame, end_date: str, max_age_days: int, min_samples: int, model_variant: str = "primary") -> DataFrame:
    """Newest run per scope and whether both are present, fresh and large enough."""
    latest = (
        runs.filter(F.col("model_variant") == model_variant)
        .groupBy("run_scope")
        .agg(F.max_by("sample_size", F.struct("created_at", "run_id")).alias("sample_size"), F.max("created_at").alias("created_at"))
    )
    scopes = F.count_if(F.col("run_scope").isin("routing_temperature", "escalation_platt"))
    age = F.greatest(F.lit(0), F.datediff(F.lit(end_date).cast("date"), F.max(F.to_date("created_at"))))
    return latest.agg(
        scopes.alias("scopes"), F.min("sample_size").alias("min_sample_size"), age.alias("age_days")
    ).withColumn(
        "passed",
        (F.col("scopes") == 2) & F.coalesce(F.col("age_days") <= max_age_days, F.lit(False))
        & F.coalesce(F.col("min_sample_size") >= min_samples, F.lit(False)))


def control_recency(events: DataFrame, as_of: str, max_age: dict[str, int] | None = None) -> DataFrame:
    """Latest passing event per control against its maximum age."""
    limits = max_age or CONTROL_MAX_AGE_DAYS
    spark = events.sparkSession
    controls = spark.createDataFrame(list(limits.items()), "control_type string, max_age_days int")
    latest = (
        events.filter(F.col("status") == "pass")
        .groupBy("control_type")
        .agg(F.max_by(F.struct("performed_at", "evidence_uri", "details"), F.struct("performed_at", "event_id")).alias("e"))
    )
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.to_date("e.performed_at")))
    live = F.lower(F.trim(F.coalesce(F.get_json_object("e.details", "$.mode"), F.lit("")))) == "live"
    status = (
        F.when(F.col("e").isNull(), "missing_pass_event")
        .when((F.col("control_type") == "incident_endpoint_verification") & ~live, "not_live_mode")
        .when(F.col("age_days") > F.col("max_age_days"), "stale")
        .otherwise("ok")
    )
    return (
        controls.join(latest, "control_type", "left")
        .withColumn("age_days", age)
        .withColumn("status", status)
        .select("control_type", "max_age_days", "age_days", "status",
                (F.col("status") == "ok").alias("passed"),
                F.col("e.performed_at").alias("performed_at"), F.col("e.evidence_uri").alias("evidence_uri"))
    )


def combine_checks(checks: list[tuple[DataFrame, Column, str, str]], extra: list[Column] | None = None) -> DataFrame:
    """One report row from one-row frames.

    Each check is (frame, pass condition, check name, blocking reason). The
    frames become tagged rows of one union and a single aggregation turns them
    into columns, so nothing is joined or collected.
    """
    tagged = None
    for i, (frame, passed, name, reason) in enumerate(checks):
        row = frame.select(
            F.lit(i).alias("seq"), F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("ok"),
            F.lit(reason).alias("reason"))
        tagged = row if tagged is None else tagged.unionByName(row)
    cols = [F.bool_and(F.when(F.col("name") == n, F.col("ok"))).alias(n) for _, _, n, _ in checks]
    reasons = F.transform(
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("seq", "reason")))), lambda r: r["reason"])
    return tagged.agg(*cols, reasons.alias("blocking_reasons"), *(extra or [])).withColumn(
        "overall_passed", F.size("blocking_reasons") == 0)


def rollout_config_state(config: DataFrame, spark: SparkSession) -> DataFrame:
    """The single config row, defaulted when missing and clamped to its ranges."""
    g = Gates()
    default = spark.createDataFrame(
        [("primary", 0, g.min_route_accuracy, g.min_escalation_recall, g.max_ece, g.max_abstain_rate, g.min_sample_size)],
        "config_id string, canary_percent int, gate_min_route_accuracy double, gate_min_escalation_recall double, "
        "gate_max_ece double, gate_max_abstain_rate double, gate_min_sample_size int")
    names = [c for c in default.columns if c != "config_id"]
    have = config.filter(F.col("config_id") == "primary").select("config_id", *[F.col(c).alias(f"have_{c}") for c in names])
    merged = default.join(have, "config_id", "left").select(
        "config_id", *[F.coalesce(f"have_{c}", c).alias(c) for c in names])
    return merged.withColumn("canary_percent", _clamped(F.col("canary_percent"))).withColumn(
        "gate_min_sample_size", F.greatest(F.lit(1), F.col("gate_min_sample_size")))
