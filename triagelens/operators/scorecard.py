"""Business KPI scorecard: ten KPIs over a current and a baseline window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import confidence_bin, optional_filter, ratio, section_key
from .percentiles import exact_percentiles

# The seeded KPI targets.
KPI_TARGETS = [
    ("assisted_coverage_pct", "gte", 0.80, "ratio", "Assisted coverage = assisted eligible tickets / eligible tickets"),
    ("agent_weekly_active_usage_pct", "gte", 0.70, "ratio", "Weekly active usage = active reviewers / active agents"),
    ("feedback_completeness_pct", "gte", 0.95, "ratio", "Closed handoffs with reviewer outcomes"),
    ("top1_route_accuracy_pct", "gte", 0.85, "ratio", "Top-1 route accuracy for labeled decisions"),
    ("escalation_precision_pct", "gte", 0.80, "ratio", "Escalation precision for labeled decisions"),
    ("escalation_recall_pct", "gte", 0.75, "ratio", "Escalation recall for labeled decisions"),
    ("ece", "lte", 0.10, "ratio", "Expected Calibration Error"),
    ("escalation_rate_reduction_pct", "gte", 0.20, "ratio", "Escalation rate reduction vs baseline window"),
    ("median_handling_time_reduction_pct", "gte", 0.25, "ratio", "Median handling time reduction vs baseline"),
    ("p90_handling_time_reduction_pct", "gte", 0.15, "ratio", "P90 handling time reduction vs baseline"),
]


@dataclass(frozen=True)
class Scope:
    """Windows (both ends included) and optional filters of one scorecard."""

    start: date
    end: date
    baseline_start: date
    baseline_end: date
    model_variant: str = "primary"
    tenant_id: str | None = None
    section: str | None = None

    @classmethod
    def trailing(cls, end: str, days: int = 28, baseline_days: int = 28, **kw) -> "Scope":
        last = date.fromisoformat(end)
        start = last - timedelta(days=days - 1)
        b_end = start - timedelta(days=1)
        return cls(start, last, b_end - timedelta(days=baseline_days - 1), b_end, **kw)

    @property
    def wau_start(self) -> date:
        return max(self.end - timedelta(days=6), self.start)


def kpi_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        KPI_TARGETS, "kpi_name string, comparator string, target_value double, unit string, description string")


def _between(col: Column, lo: date, hi: date) -> Column:
    return col.between(F.lit(lo), F.lit(hi))


def _day_span(ts: Column, lo: date, hi: date) -> Column:
    """Timestamp range for whole days, so the filter reaches the scan."""
    return (ts >= F.lit(lo).cast("timestamp")) & (ts < F.lit(hi + timedelta(days=1)).cast("timestamp"))


def _scoped_requests(requests: DataFrame, s: Scope) -> DataFrame:
    out = optional_filter(requests, F.col("tenant_id"), s.tenant_id)
    return optional_filter(out, section_key(F.col("section")), s.section)


def _kpi(name: str, df: DataFrame, value: Column, details: Column) -> DataFrame:
    return df.select(F.lit(name).alias("kpi_name"), value.alias("actual_value"), details.alias("details"))


def assisted_coverage(requests: DataFrame, results: DataFrame, workload: DataFrame, s: Scope) -> DataFrame:
    """Assisted requests over eligible tickets; may exceed one."""
    req = _scoped_requests(requests.filter(_day_span(F.col("created_at"), s.start, s.end)), s).select("request_id")
    served = results.filter(F.col("model_variant") == s.model_variant).select("request_id")
    wl = optional_filter(workload.filter(_between(F.col("metric_date"), s.start, s.end)), F.col("tenant_id"), s.tenant_id)
    wl = optional_filter(wl, F.col("section"), s.section)
    parts = (
        req.join(served, "request_id").agg(F.count(F.lit(1)).cast("double").alias("assisted"))
        .withColumn("eligible", F.lit(None).cast("double"))
        .unionByName(
            wl.agg(F.sum("eligible_tickets_total").cast("double").alias("eligible"))
            .withColumn("assisted", F.lit(None).cast("double")))
    )
    one = parts.agg(F.max("assisted").alias("assisted"), F.max("eligible").alias("eligible"))
    return _kpi("assisted_coverage_pct", one, ratio(F.col("assisted"), F.col("eligible")),
                F.to_json(F.struct(F.col("assisted").alias("assisted_requests"), F.col("eligible").alias("eligible_tickets"))))


def reviewers_in_scope(outcomes: DataFrame, requests: DataFrame, lo: date, hi: date, s: Scope) -> DataFrame:
    """Outcomes of requests in scope, joined on request and tenant."""
    out = optional_filter(outcomes.filter(_day_span(F.col("created_at"), lo, hi)), F.col("tenant_id"), s.tenant_id)
    req = requests.select("request_id", "tenant_id", section_key(F.col("section")).alias("section"))
    req = optional_filter(req, F.col("section"), s.section)
    return out.select("request_id", "tenant_id", "reviewer_id").join(req, ["request_id", "tenant_id"])


def weekly_active_usage(outcomes: DataFrame, requests: DataFrame, workload: DataFrame, s: Scope,
                        approximate: bool = False) -> DataFrame:
    """Distinct reviewers of the last seven days over the peak of active agents."""
    revs = reviewers_in_scope(outcomes, requests, s.wau_start, s.end, s)
    distinct = F.approx_count_distinct("reviewer_id") if approximate else F.countDistinct("reviewer_id")
    wl = optional_filter(workload.filter(_between(F.col("metric_date"), s.wau_start, s.end)), F.col("tenant_id"), s.tenant_id)
    wl = optional_filter(wl, F.col("section"), s.section)
    none = F.lit(None).cast("double")
    one = (
        revs.agg(distinct.cast("double").alias("reviewers")).withColumn("agents", none)
        .unionByName(wl.agg(F.max("active_agents_total").cast("double").alias("agents")).withColumn("reviewers", none))
        .agg(F.max("reviewers").alias("reviewers"), F.max("agents").alias("agents"))
    )
    return _kpi("agent_weekly_active_usage_pct", one, ratio(F.col("reviewers"), F.col("agents")),
                F.to_json(F.struct(F.col("reviewers").alias("active_reviewers_7d"), F.col("agents").alias("active_agents_7d"))))


def closed_handoffs(handoffs: DataFrame, requests: DataFrame, s: Scope) -> DataFrame:
    closed = optional_filter(handoffs.filter(F.col("queue_status") == "closed"), F.col("tenant_id"), s.tenant_id)
    req = requests.filter(_day_span(F.col("created_at"), s.start, s.end)).select(
        "request_id", section_key(F.col("section")).alias("section"))
    return closed.select("handoff_id", "request_id", "tenant_id").join(
        optional_filter(req, F.col("section"), s.section), "request_id")


def closed_with_outcome(handoffs: DataFrame, requests: DataFrame, outcomes: DataFrame, s: Scope) -> DataFrame:
    return closed_handoffs(handoffs, requests, s).join(outcomes.select("handoff_id"), "handoff_id", "left_semi")


def closed_missing_outcome(handoffs: DataFrame, outcomes: DataFrame, tenant_id: str | None = None) -> DataFrame:
    closed = optional_filter(handoffs.filter(F.col("queue_status") == "closed"), F.col("tenant_id"), tenant_id)
    return closed.join(outcomes.select("handoff_id"), "handoff_id", "left_anti")


def label_counts(handoffs: DataFrame, requests: DataFrame, outcomes: DataFrame, s: Scope) -> DataFrame:
    """Closed handoffs in the window and how many lack an outcome.

    The outcome side is reduced to one row per handoff before the join, so a
    handoff with many outcomes counts once and brings one row across.
    """
    seen = outcomes.groupBy("handoff_id").agg(F.count(F.lit(1)).alias("outcomes"))
    return closed_handoffs(handoffs, requests, s).join(seen, "handoff_id", "left").agg(
        F.count(F.lit(1)).alias("closed_handoffs"),
        F.count_if(F.col("outcomes").isNull()).alias("missing_outcomes"),
    )


def feedback_completeness(handoffs: DataFrame, requests: DataFrame, outcomes: DataFrame, s: Scope) -> DataFrame:
    one = label_counts(handoffs, requests, outcomes, s).withColumn(
        "with_outcome", F.col("closed_handoffs") - F.col("missing_outcomes"))
    return _kpi("feedback_completeness_pct", one, ratio(F.col("with_outcome"), F.col("closed_handoffs")),
                F.to_json(F.struct(F.col("closed_handoffs").cast("double").alias("closed_handoffs"),
                                   F.col("with_outcome").cast("double").alias("closed_with_outcome"))))


def _labelled(dataset: DataFrame, s: Scope) -> DataFrame:
    """Labelled served rows of both windows, marked current or baseline."""
    day = F.col("eval_date")
    cur, base = _between(day, s.start, s.end), _between(day, s.baseline_start, s.baseline_end)
    rows = dataset.filter(
        _between(day, min(s.start, s.baseline_start), max(s.end, s.baseline_end))
        & (cur | base)
        & (F.col("source") == "inference_results")
        & (F.col("model_variant") == s.model_variant)
        & F.col("ground_truth_decision").isNotNull()
    )
    rows = optional_filter(rows, F.col("tenant_id"), s.tenant_id)
    rows = optional_filter(rows, section_key(F.col("section")), s.section)
    return rows.withColumn("is_current", cur)


def labelled_kpis(dataset: DataFrame, s: Scope) -> DataFrame:
    """The seven KPIs that come from labelled rows, from one scan.

    Rows collapse to (window, bucket, handling seconds) counts first; rates are
    sums over those counts and percentiles narrow down on the counts of each
    handling time, so no task holds all of them.
    """
    correct = F.col("is_route_correct")
    bucket = F.when(correct.isNotNull(), confidence_bin(F.col("final_confidence"))).otherwise(F.lit(-1))
    pred, actual = F.col("is_escalation_pred"), F.col("is_escalation_actual")
    per = (
        _labelled(dataset, s)
        .groupBy("is_current", bucket.alias("bin_id"), "resolution_seconds")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(correct.cast("double")).alias("n_correct"),
            F.sum(F.coalesce("final_confidence", F.lit(0.0))).alias("sum_conf"),
            F.count_if(pred).alias("n_pred"),
            F.count_if(actual).alias("n_actual"),
            F.count_if(pred & actual).alias("n_tp"),
            F.count_if(F.col("predicted_decision") == "escalate").alias("n_escalate"),
        )
    )
    cur = F.col("is_current")

    def now(c: str) -> Column:
        return F.coalesce(F.sum(F.when(cur, F.col(c))), F.lit(0))

    def before(c: str) -> Column:
        return F.sum(F.when(~cur, F.col(c)))

    times = exact_percentiles(per.select("is_current", F.col("resolution_seconds").cast("double").alias("value"), "n"), ["is_current"], [0.5, 0.9])

    def pct(p: float, side: Column) -> Column:
        return times.where(side & (F.col("share") == p)).select("value").scalar()

    bins = per.filter(cur & (F.col("bin_id") >= 0)).groupBy("bin_id").agg(
        F.sum("n").alias("n"), F.sum("n_correct").alias("c"), F.sum("sum_conf").alias("f"))
    cal = bins.agg(
        ratio(F.sum(F.abs(F.col("c") / F.col("n") - F.col("f") / F.col("n")) * F.col("n")), F.sum("n")).alias("v"),
        F.count(F.lit(1)).alias("k"),
    )
    one = per.agg(
        now("n").alias("n"),
        ratio(now("n_correct"), F.sum(F.when(cur & (F.col("bin_id") >= 0), F.col("n")))).alias("accuracy"),
        now("n_pred").alias("n_pred"), now("n_actual").alias("n_actual"), now("n_tp").alias("n_tp"),
        ratio(F.sum(F.when(cur, F.col("n_escalate"))), F.sum(F.when(cur, F.col("n")))).alias("esc_now"),
        ratio(before("n_escalate"), before("n")).alias("esc_base"),
    ).withColumns({"p50_now": pct(0.5, cur), "p90_now": pct(0.9, cur), "p50_base": pct(0.5, ~cur), "p90_base": pct(0.9, ~cur)})

    def reduction(base: str, now_: str) -> Column:
        return (F.col(base) - F.col(now_)) / F.nullif(F.col(base), F.lit(0.0))

    def row(name: str, value: Column, **details: Column) -> Column:
        return F.struct(
            F.lit(name).alias("kpi_name"), value.alias("actual_value"),
            F.to_json(F.struct(*[c.alias(k) for k, c in details.items()])).alias("details"))

    c = F.col
    rows = F.array(
        row("top1_route_accuracy_pct", c("accuracy"), labeled_samples=c("n")),
        row("escalation_precision_pct", ratio(c("n_tp"), c("n_pred")),
            predicted_escalations=c("n_pred"), true_positive_escalations=c("n_tp")),
        row("escalation_recall_pct", ratio(c("n_tp"), c("n_actual")),
            actual_escalations=c("n_actual"), true_positive_escalations=c("n_tp")),
        row("escalation_rate_reduction_pct", reduction("esc_base", "esc_now"),
            current_escalation_rate=c("esc_now"), baseline_escalation_rate=c("esc_base")),
        row("median_handling_time_reduction_pct", reduction("p50_base", "p50_now"),
            current_p50_seconds=c("p50_now"), baseline_p50_seconds=c("p50_base")),
        row("p90_handling_time_reduction_pct", reduction("p90_base", "p90_now"),
            current_p90_seconds=c("p90_now"), baseline_p90_seconds=c("p90_base")),
    )
    return one.select(F.inline(rows)).unionByName(
        _kpi("ece", cal, F.col("v"), F.to_json(F.struct(F.col("k").alias("ece_bins")))))


def kpi_values(tables: dict[str, DataFrame], s: Scope) -> DataFrame:
    """All ten KPIs as (kpi_name, actual_value, details)."""
    return (
        assisted_coverage(tables["requests"], tables["results"], tables["workload"], s)
        .unionByName(weekly_active_usage(tables["outcomes"], tables["requests"], tables["workload"], s))
        .unionByName(feedback_completeness(tables["handoffs"], tables["requests"], tables["outcomes"], s))
        .unionByName(labelled_kpis(tables["dataset"], s))
    )


def targets_left_kpis(targets: DataFrame, kpis: DataFrame) -> DataFrame:
    met = F.when(F.col("comparator") == "gte", F.col("actual_value") >= F.col("target_value")).when(
        F.col("comparator") == "lte", F.col("actual_value") <= F.col("target_value"))
    return targets.join(kpis, "kpi_name", "left").withColumn(
        "status",
        F.when(F.col("actual_value").isNull(), "insufficient_data").when(met, "pass").otherwise("fail"))


def scorecard(tables: dict[str, DataFrame], s: Scope, targets: DataFrame | None = None) -> DataFrame:
    spark = tables["dataset"].sparkSession
    return targets_left_kpis(targets if targets is not None else kpi_targets(spark), kpi_values(tables, s))


# -- formatting -------------------------------------------------------------


def format_percent(v: Column) -> Column:
    return F.when(v.isNull(), "n/a").otherwise(F.format_string("%.2f%%", v * 100))


def format_ratio(v: Column) -> Column:
    return F.when(v.isNull(), "n/a").otherwise(F.format_string("%.4f", v))


def format_value(unit: Column, v: Column) -> Column:
    return F.when(unit == "ratio", format_percent(v)).otherwise(format_ratio(v))


# -- workload ---------------------------------------------------------------


def date_gaps(workload: DataFrame, start: str, end: str, tenant_id: str | None = None, section: str | None = None) -> DataFrame:
    """Calendar days of the window without a workload row."""
    spark = workload.sparkSession
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("metric_date"))
    present = workload.filter(F.col("metric_date").between(lo, hi))
    present = optional_filter(present, F.col("tenant_id"), tenant_id)
    present = optional_filter(present, F.col("section"), section)
    return calendar.join(present.select("metric_date").distinct(), "metric_date", "left_anti")


def workload_coverage(workload: DataFrame, start: str, end: str, tenant_id: str | None = None, section: str | None = None) -> DataFrame:
    """Present / expected days and the list of missing ones, one row."""
    spark = workload.sparkSession
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = workload.filter(F.col("metric_date").between(lo, hi))
    rows = optional_filter(rows, F.col("tenant_id"), tenant_id)
    rows = optional_filter(rows, F.col("section"), section)
    per_day = rows.groupBy("metric_date").agg(F.count(F.lit(1)).alias("row_count"))
    calendar = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("metric_date"))
    return calendar.join(per_day, "metric_date", "left").agg(
        F.count("row_count").alias("present_dates"),
        F.count(F.lit(1)).alias("expected_dates"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.array_sort(F.collect_list(F.when(F.col("row_count").isNull(), F.col("metric_date").cast("string")))).alias("missing_dates"),
    ).withColumn("passed", F.size("missing_dates") == 0)


def workload_stats(workload: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return workload.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("eligible_tickets_total").alias("mean_tickets"),
        F.min("eligible_tickets_total").alias("min_tickets"),
        F.max("eligible_tickets_total").alias("max_tickets"),
        F.avg("active_agents_total").alias("mean_agents"),
        (F.max("active_agents_total") - F.min("active_agents_total")).alias("agent_range"),
        ratio(F.sum("eligible_tickets_total"), F.sum("active_agents_total")).alias("tickets_per_agent"),
    )
