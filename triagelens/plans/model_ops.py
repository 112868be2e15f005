"""Daily model-ops job: dataset, metrics and drift for one date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources import tables as T


def daily_frames(requests: DataFrame, results: DataFrame, shadow: DataFrame, outcomes: DataFrame, feedback: DataFrame,
                 day: str, history: DataFrame | None = None, baseline_days: int = E.DRIFT_BASELINE_DAYS) -> dict[str, DataFrame]:
    """Frames of one day; ``history`` is the stored dataset of earlier days."""
    d = F.lit(day).cast("date")
    events = E.prediction_events(requests, results, shadow)
    truth = E.latest_ground_truth(outcomes, feedback)
    if history is None:
        recent = E.daily_eval_dataset(
            events.filter((F.col("eval_date") >= F.date_sub(d, baseline_days)) & (F.col("eval_date") <= d)), truth)
        today = recent.filter(F.col("eval_date") == d)
    else:
        today = E.daily_eval_dataset(events, truth, day)
        recent = history.filter((F.col("eval_date") >= F.date_sub(d, baseline_days)) & (F.col("eval_date") < d)).unionByName(today)
    metrics = E.metrics_with_ece(recent)
    return {
        "dataset": today,
        "metrics": metrics.filter(F.col("eval_date") == d),
        "drift": E.drift_metrics(recent, metrics, day, baseline_days),
    }


def run_daily(frames: dict[str, DataFrame], dataset_path: str, metrics_path: str, drift_path: str) -> DataFrame:
    """Replace the day's partitions and return its drift alerts (alert rows only)."""
    T.replace_partition(frames["dataset"], dataset_path, ["eval_date"])
    T.replace_partition(frames["metrics"], metrics_path, ["eval_date"])
    T.replace_partition(frames["drift"], drift_path, ["drift_date"])
    return frames["drift"].filter("is_alert")
