"""Prediction log + labels -> daily dataset, quality metrics, ECE and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_SECTIONS = "__all__"

# Drift thresholds and baseline length.
DRIFT_INPUT_THRESHOLD = 0.30
DRIFT_CONFIDENCE_THRESHOLD = 0.12
DRIFT_OUTCOME_THRESHOLD = 0.10
DRIFT_BASELINE_DAYS = 14
DRIFT_BASELINE_MIN_DAYS = 3


# -- small column helpers ---------------------------------------------------


def section_key(section: Column) -> Column:
    """Label for rows without a section; not a rollup."""
    return F.coalesce(section, F.lit(ALL_SECTIONS))


def as_rate(flag: Column) -> Column:
    """Three-valued flag as 1.0 / 0.0 / NULL for averaging."""
    return flag.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL where the denominator is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.split(F.trim(text), r"\s+")))


def nullable_correctness(predicted: Column, truth: Column) -> Column:
    return F.when(predicted.isNotNull() & truth.isNotNull(), predicted == truth)


def shadow_decision(decision: Column, escalation_prob: Column) -> Column:
    """Shadow rows without a decision escalate from one half up."""
    return F.coalesce(decision, F.when(escalation_prob >= 0.5, "escalate").otherwise("recommend"))


def optional_value(raw: str | None) -> str | None:
    """A filter argument; blank and the wildcard spellings mean no filter."""
    value = (raw or "").strip()
    return None if value.lower() in {"", "all", "__all__", "*"} else value


def optional_filter(df: DataFrame, column: Column, raw: str | None) -> DataFrame:
    value = optional_value(raw)
    return df if value is None else df.filter(column == value)


# -- views ------------------------------------------------------------------


def prediction_events(requests: DataFrame, results: DataFrame, shadow: DataFrame) -> DataFrame:
    """Served predictions and shadow predictions in one event list."""
    req = requests.select("request_id", "tenant_id", "section", "issue_text", F.to_date("created_at").alias("eval_date"))
    served = req.join(
        results.select(
            "request_id", "model_variant", F.col("decision").alias("predicted_decision"),
            F.col("top_resolution_path").alias("predicted_route"),
            F.col("top_resolution_prob").alias("predicted_route_prob"),
            "escalation_prob", "final_confidence", "model_backend_fallback",
        ),
        "request_id",
    ).withColumn("source", F.lit("inference_results"))
    logged = (
        shadow.select(
            "request_id", "tenant_id", "model_variant",
            shadow_decision(F.col("decision"), F.col("escalation_prob")).alias("predicted_decision"),
            F.col("top_resolution_path").alias("predicted_route"),
            F.col("top_resolution_prob").alias("predicted_route_prob"),
            "escalation_prob", "final_confidence", "model_backend_fallback",
            F.concat(F.lit("shadow:"), F.col("traffic_bucket")).alias("source"),
            F.to_date("created_at").alias("eval_date"),
        )
        .join(req.drop("eval_date"), ["request_id", "tenant_id"])
    )
    return served.unionByName(logged)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key by the struct of ``order`` (largest wins).

    ``max_by`` keeps one row per key on the map side before the shuffle, so a
    key with very many versions does not gather in one task as it would for a
    row_number window.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*")


def latest_ground_truth(outcomes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Newest reviewer outcome and newest feedback per request; reviewer wins."""
    keys = ["request_id", "tenant_id"]
    reviewer = latest_per_key(
        outcomes.select(*keys, "outcome_id", "final_decision", "final_resolution_path", "resolution_seconds",
                        F.col("created_at").alias("reviewed_at")),
        keys, [F.col("reviewed_at"), F.col("outcome_id")],
    ).drop("outcome_id")
    fb = latest_per_key(
        feedback.filter(F.col("request_id").isNotNull()).select(
            *keys, "event_id", "accepted_decision", "corrected_resolution_path",
            F.col("created_at").alias("feedback_at")),
        keys, [F.col("feedback_at"), F.col("event_id")],
    ).drop("event_id")
    return reviewer.join(fb, keys, "full").select(
        *keys,
        F.col("final_decision").alias("reviewer_final_decision"),
        F.col("final_resolution_path").alias("reviewer_final_resolution_path"),
        F.col("accepted_decision").alias("feedback_decision"),
        F.col("corrected_resolution_path").alias("feedback_resolution_path"),
        F.coalesce("final_decision", "accepted_decision").alias("ground_truth_decision"),
        F.coalesce("final_resolution_path", "corrected_resolution_path").alias("ground_truth_route"),
        "resolution_seconds",
        F.coalesce("reviewed_at", "feedback_at").alias("ground_truth_created_at"),
    )


def daily_eval_dataset(events: DataFrame, truth: DataFrame, eval_date: str | None = None) -> DataFrame:
    """Labelled prediction rows; one day, or every day for a backfill.

    The key is (eval_date, request_id, model_variant, source): a canary request
    is logged by both the served and the shadow path under the same variant.
    """
    ev = events if eval_date is None else events.filter(F.col("eval_date") == F.lit(eval_date).cast("date"))
    gt = truth.select("request_id", "tenant_id", "ground_truth_decision", "ground_truth_route", "resolution_seconds")
    return ev.join(gt, ["request_id", "tenant_id"], "left").select(
        "eval_date", "request_id", "tenant_id", "section", "model_variant", "predicted_decision",
        "predicted_route", "predicted_route_prob", "escalation_prob", "final_confidence",
        "ground_truth_decision", "ground_truth_route",
        nullable_correctness(F.col("predicted_route"), F.col("ground_truth_route")).alias("is_route_correct"),
        F.coalesce(F.col("predicted_decision") == "escalate", F.lit(False)).alias("is_escalation_pred"),
        F.coalesce(F.col("ground_truth_decision") == "escalate", F.lit(False)).alias("is_escalation_actual"),
        token_count(F.col("issue_text")).alias("issue_token_count"),
        "resolution_seconds", "source",
    )


# -- metrics ----------------------------------------------------------------


def confidence_bin(confidence: Column) -> Column:
    """Ten equal buckets; 1.0 and above fall in bucket 11, below 0 in bucket 0."""
    return F.width_bucket(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0), F.lit(1.0), F.lit(10))


def _quality_columns() -> list[Column]:
    pred, actual = F.col("is_escalation_pred"), F.col("is_escalation_actual")
    tp = F.count_if(pred & actual)
    return [
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(as_rate(F.col("is_route_correct"))).alias("route_accuracy"),
        ratio(tp, F.count_if(pred)).alias("escalation_precision"),
        ratio(tp, F.count_if(actual)).alias("escalation_recall"),
        F.avg((F.col("predicted_decision") == "abstain").cast("double")).alias("abstain_rate"),
        F.avg(F.col("resolution_seconds").cast("double")).alias("avg_time_to_resolution_seconds"),
    ]


def daily_quality_metrics(dataset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Quality metrics per (date, tenant, section, variant)."""
    keys = ["eval_date", "tenant_id", "section", "model_variant"] if keys is None else keys
    return dataset.withColumn("section", section_key(F.col("section"))).groupBy(*keys).agg(*_quality_columns())


def ece(dataset: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error per ``keys`` (no keys: one row)."""
    return _ece_from_bins(_ece_bins(dataset, keys), keys)


def _ece_bins(dataset: DataFrame, keys: list[str]) -> DataFrame:
    labelled = dataset.filter(F.col("is_route_correct").isNotNull())
    if "section" in keys:
        labelled = labelled.withColumn("section", section_key(F.col("section")))
    conf = F.coalesce("final_confidence", F.lit(0.0))
    return labelled.groupBy(*keys, confidence_bin(F.col("final_confidence")).alias("bin_id")).agg(
        F.count(F.lit(1)).alias("n_bin"),
        F.avg(conf).alias("avg_conf"),
        F.avg(as_rate(F.col("is_route_correct"))).alias("avg_acc"),
    )


def _ece_from_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("avg_acc") - F.col("avg_conf")) * F.col("n_bin")
    return bins.groupBy(*keys).agg(
        ratio(F.sum(gap), F.sum("n_bin")).alias("ece"), F.count(F.lit(1)).alias("ece_bins")
    )


def metrics_with_ece(dataset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Quality metrics and ECE from one pass over the dataset.

    Both are derived from per-bucket partial sums, so the large table is read
    and shuffled once; what is left after the first step is at most 13 rows per
    key. NULL route correctness keeps its own bucket (-1) and carries no ECE.
    """
    keys = ["eval_date", "tenant_id", "section", "model_variant"] if keys is None else keys
    correct = F.col("is_route_correct")
    bucket = F.when(correct.isNotNull(), confidence_bin(F.col("final_confidence"))).otherwise(F.lit(-1))
    pred, actual = F.col("is_escalation_pred"), F.col("is_escalation_actual")
    partial = (
        dataset.withColumn("section", section_key(F.col("section")))
        .groupBy(*keys, bucket.alias("bin_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(as_rate(correct)).alias("n_correct"),
            F.sum(F.coalesce("final_confidence", F.lit(0.0))).alias("sum_conf"),
            F.count_if(pred).alias("n_pred"),
            F.count_if(actual).alias("n_actual"),
            F.count_if(pred & actual).alias("n_tp"),
            F.count_if(F.col("predicted_decision") == "abstain").alias("n_abstain"),
            F.sum("resolution_seconds").alias("sum_res"),
            F.count("resolution_seconds").alias("n_res"),
        )
    )
    labelled_n = F.sum(F.when(F.col("bin_id") >= 0, F.col("n")))
    gap = F.when(F.col("bin_id") >= 0, F.abs(F.col("n_correct") / F.col("n") - F.col("sum_conf") / F.col("n")) * F.col("n"))
    return partial.groupBy(*keys).agg(
        F.sum("n").alias("sample_size"),
        ratio(F.sum("n_correct"), labelled_n).alias("route_accuracy"),
        ratio(F.sum("n_tp"), F.sum("n_pred")).alias("escalation_precision"),
        ratio(F.sum("n_tp"), F.sum("n_actual")).alias("escalation_recall"),
        ratio(F.sum(gap), labelled_n).alias("ece"),
        ratio(F.sum("n_abstain"), F.sum("n")).alias("abstain_rate"),
        ratio(F.sum("sum_res"), F.sum("n_res")).alias("avg_time_to_resolution_seconds"),
    )


# -- canary -----------------------------------------------------------------


def source_scope(current_percent: int) -> str:
    return "shadow_or_canary" if int(current_percent) <= 0 else "canary_only"


def in_scope(dataset: DataFrame, scope: str) -> DataFrame:
    src = F.col("source")
    return dataset.filter(src.startswith("shadow:") if scope == "shadow_or_canary" else src == "shadow:canary")


def canary_window_metrics(dataset: DataFrame, eval_date: str, lookback_days: int, current_percent: int) -> DataFrame:
    """One row of challenger metrics over ``lookback_days`` ending at ``eval_date``."""
    end = F.date_add(F.lit(eval_date).cast("date"), 1)
    scoped = in_scope(
        dataset.filter(
            (F.col("eval_date") >= F.date_sub(end, lookback_days))
            & (F.col("eval_date") < end)
            & (F.col("model_variant") == "challenger")
        ),
        source_scope(current_percent),
    )
    return _canary_columns(scoped, [])


def canary_daily_metrics(
    dataset: DataFrame, start: str, end: str, model_variant: str = "challenger",
    tenant_id: str | None = None, section: str | None = None,
) -> DataFrame:
    """Challenger canary metrics per day, both ends included."""
    scoped = in_scope(
        dataset.filter(
            F.col("eval_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
            & (F.col("model_variant") == model_variant)
        ),
        "canary_only",
    )
    scoped = optional_filter(scoped, F.col("tenant_id"), tenant_id)
    scoped = optional_filter(scoped, F.col("section"), section)
    return _canary_columns(scoped, ["eval_date"])


def _canary_columns(scoped: DataFrame, keys: list[str]) -> DataFrame:
    prepared = scoped.withColumn("is_escalation_pred", F.coalesce(F.col("predicted_decision") == "escalate", F.lit(False)))
    return metrics_with_ece(prepared, keys).select(
        *keys,
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        "route_accuracy", "escalation_recall", "ece", "abstain_rate",
    )


# -- drift ------------------------------------------------------------------


def _aligned(
    source: DataFrame, value: Column, drift_date: str, baseline_days: int, section: Column,
) -> DataFrame:
    """Current and baseline mean per (tenant, section) in one aggregation.

    Groups without a current value drop out; a missing baseline takes the
    current value, so its delta is zero.
    """
    day = F.lit(drift_date).cast("date")
    window = source.filter((F.col("eval_date") >= F.date_sub(day, baseline_days)) & (F.col("eval_date") <= day))
    is_now = F.col("eval_date") == day
    return (
        window.groupBy("tenant_id", section.alias("section"))
        .agg(
            F.avg(F.when(is_now, value)).alias("current_value"),
            F.avg(F.when(~is_now, value)).alias("baseline_value"),
        )
        .filter(F.col("current_value").isNotNull())
        .withColumn("baseline_value", F.coalesce("baseline_value", "current_value"))
    )


def drift_align(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """The same alignment for two precomputed (tenant, section, value) frames."""
    keys = ["tenant_id", "section"]
    cur = current.filter(F.col("value").isNotNull()).select(*keys, F.col("value").alias("current_value"))
    base = baseline.filter(F.col("value").isNotNull()).select(*keys, F.col("value").alias("baseline_value"))
    return cur.join(base, keys, "left").withColumn("baseline_value", F.coalesce("baseline_value", "current_value"))


def drift_metrics(
    dataset: DataFrame,
    daily_metrics: DataFrame,
    drift_date: str,
    baseline_days: int = DRIFT_BASELINE_DAYS,
    input_threshold: float = DRIFT_INPUT_THRESHOLD,
    confidence_threshold: float = DRIFT_CONFIDENCE_THRESHOLD,
    outcome_threshold: float = DRIFT_OUTCOME_THRESHOLD,
) -> DataFrame:
    """Input, confidence and outcome drift of one day against its baseline."""
    days = max(DRIFT_BASELINE_MIN_DAYS, int(baseline_days))
    key = section_key(F.col("section"))
    delta = F.abs(F.col("current_value") - F.col("baseline_value"))
    parts = [
        ("input_token_mean_relative_delta", dataset, F.col("issue_token_count").cast("double"), input_threshold,
         delta / F.greatest(F.abs("baseline_value"), F.lit(1.0)), key),
        ("confidence_mean_abs_delta", dataset, F.col("final_confidence"), confidence_threshold, delta, key),
        ("route_accuracy_abs_delta", daily_metrics.filter(F.col("model_variant") == "primary"),
         F.col("route_accuracy"), outcome_threshold, delta, F.col("section")),
    ]
    frames = [
        _aligned(src, value, drift_date, days, sec)
        .withColumn("metric_name", F.lit(name))
        .withColumn("delta_value", score)
        .withColumn("threshold", F.lit(limit))
        for name, src, value, limit, score, sec in parts
    ]
    return (
        frames[0].unionByName(frames[1]).unionByName(frames[2])
        .withColumn("is_alert", F.col("delta_value") > F.col("threshold"))
        .withColumn("drift_date", F.lit(drift_date).cast("date"))
    )


def drift_alert_counts(drift: DataFrame, start: str, end: str, tenant_id: str | None = None, section: str | None = None) -> DataFrame:
    win = drift.filter(F.col("drift_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    win = optional_filter(win, F.col("tenant_id"), tenant_id)
    win = optional_filter(win, F.col("section"), section)
    return win.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("is_alert").alias("alert_rows"))
