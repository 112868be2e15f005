"""Calibration fits over a parameter grid."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The clip bound and the search grids.
EPS = 1e-6
TEMPERATURES = [round(0.5 + 0.05 * i, 10) for i in range(51)]
PLATT_A = [round(0.4 + 0.1 * i, 10) for i in range(27)]
PLATT_B = [round(-2.0 + 0.1 * i, 10) for i in range(41)]


def clip_probability(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), p))


def logit(p: Column) -> Column:
    c = clip_probability(p)
    return F.ln(c / (F.lit(1.0) - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sample_loss(p: Column, label: Column) -> Column:
    c = clip_probability(p)
    return -F.when(label, F.ln(c)).otherwise(F.ln(F.lit(1.0) - c))


def log_loss(df: DataFrame, prob: str, label: str, keys: list[str] | None = None) -> DataFrame:
    loss = F.coalesce(F.avg(sample_loss(F.col(prob), F.col(label))), F.lit(0.0))
    return df.groupBy(*(keys or [])).agg(loss.alias("log_loss"), F.count(F.lit(1)).alias("sample_size"))


def calibration_samples(dataset: DataFrame, start: str, end: str, model_variant: str, prob: str, label: str) -> DataFrame:
    """Distinct (probability, label) pairs with their counts, ``[start, end)``.

    Stored probabilities have four decimals, so this is at most 20,002 rows
    however large the window is; the grid below multiplies only these.
    """
    return (
        dataset.filter(
            (F.col("eval_date") >= F.lit(start).cast("date"))
            & (F.col("eval_date") < F.lit(end).cast("date"))
            & (F.col("model_variant") == model_variant)
            & F.col(prob).isNotNull()
            & F.col(label).isNotNull()
        )
        .groupBy(F.col(prob).alias("prob"), F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def calibration_grid(samples: DataFrame, params: dict[str, list[float]]) -> DataFrame:
    """Samples times every grid point, as a narrow explode of literals."""
    out = samples
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out


def _fit(samples: DataFrame, params: dict[str, list[float]], calibrated: Column, default: dict[str, float]) -> DataFrame:
    names = list(params)
    losses = (
        calibration_grid(samples, params)
        .groupBy(*names)
        .agg(
            (F.sum(F.col("n") * sample_loss(calibrated, F.col("label"))) / F.sum("n")).alias("loss"),
            F.sum("n").alias("sample_size"),
        )
    )
    # Ten digits keep float noise from deciding between equal losses; then the
    # first grid point in scan order wins.
    best = F.min_by(F.struct(*names, "loss", "sample_size"), F.struct(F.round("loss", 10), *names))
    return losses.agg(best.alias("fit")).select(
        *[F.coalesce(F.col(f"fit.{n}"), F.lit(default[n])).alias(n) for n in names],
        F.coalesce("fit.loss", F.lit(0.0)).alias("loss"),
        F.coalesce("fit.sample_size", F.lit(0)).alias("sample_size"),
    )


def fit_temperature(samples: DataFrame) -> DataFrame:
    return _fit(
        samples, {"temperature": TEMPERATURES},
        sigmoid(logit(F.col("prob")) / F.col("temperature")), {"temperature": 1.0},
    )


def fit_platt(samples: DataFrame) -> DataFrame:
    return _fit(
        samples, {"a": PLATT_A, "b": PLATT_B},
        sigmoid(F.col("a") * logit(F.col("prob")) + F.col("b")), {"a": 1.0, "b": 0.0},
    )


def recalibrate(dataset: DataFrame, today: str, lookback_days: int, model_variant: str = "primary") -> DataFrame:
    """Both fits as calibration run records."""
    start = (date.fromisoformat(today) - timedelta(days=lookback_days)).isoformat()
    routing = fit_temperature(
        calibration_samples(dataset, start, today, model_variant, "predicted_route_prob", "is_route_correct"))
    escalation = fit_platt(
        calibration_samples(dataset, start, today, model_variant, "escalation_prob", "is_escalation_actual"))
    runs = routing.select(
        F.lit("routing_temperature").alias("run_scope"), "sample_size",
        F.col("temperature").alias("param_a"), F.lit(None).cast("double").alias("param_b"), "loss",
    ).unionByName(
        escalation.select(
            F.lit("escalation_platt").alias("run_scope"), "sample_size",
            F.col("a").alias("param_a"), F.col("b").alias("param_b"), "loss",
        )
    )
    return runs.withColumn("model_variant", F.lit(model_variant))
