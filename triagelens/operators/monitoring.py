"""Counters, histograms, gauges and probe summaries over telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V


def metric_counters(events: DataFrame, labels: list[str], name: str, when: Column | None = None) -> DataFrame:
    src = events if when is None else events.filter(when)
    return src.groupBy(*labels).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit(name))


def metric_histogram(events: DataFrame, value: Column, name: str, labels: list[str]) -> DataFrame:
    """Cumulative bucket counts (le), with +Inf, count and sum per label set.

    Rows collapse to one count per bucket before the running totals.
    """
    bounds = [float(b) for b in V.HISTOGRAM_BUCKETS[name]]
    arr = F.array(*[F.lit(b) for b in bounds])
    slot = F.size(F.filter(arr, lambda b: b < F.col("_v")))
    per = events.withColumn("_v", F.greatest(F.lit(0.0), value.cast("double"))).groupBy(*labels, slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"))
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit("+Inf" if i == len(bounds) else repr(bounds[i])).alias("le")) for i in range(len(bounds) + 1)])
    spread = per.select(*labels, "slot", "n", "s", F.inline(every))
    return spread.groupBy(*labels, "i", "le").agg(
        F.sum(F.when(F.col("slot") <= F.col("i"), F.col("n")).otherwise(0)).alias("cumulative"), F.sum("s").alias("total_sum")
    ).withColumn("metric", F.lit(name)).drop("i")


def metric_gauge(events: DataFrame, value: Column, name: str, labels: list[str], order: list[str]) -> DataFrame:
    """Last value per label set."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value")).withColumn("metric", F.lit(name))


def success_status(status: Column) -> Column:
    return status.between(200, 299)


def probe_summary(results: DataFrame, keys: list[str], max_error_rate: float, max_p95_ms: float) -> DataFrame:
    """Totals, nearest-rank percentiles and pass flag per probe run.

    The percentile position is round(p/100 * (n - 1)). Latencies collapse to
    (value, count) rows; a running count finds the value at each position.
    """
    totals = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(success_status(F.col("status"))).alias("ok"), F.avg("latency_ms").alias("mean_latency_ms"))
    counts = results.filter(F.col("latency_ms").isNotNull()).groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("latency_ms")
    run = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))

    def at(p: float) -> Column:
        position = F.bround(F.lit(p / 100.0) * (F.col("all") - 1), 0)
        return F.min(F.when(F.col("upto") > position, F.col("latency_ms")))

    ranks = run.groupBy(*keys).agg(at(50.0).alias("p50_latency_ms"), at(95.0).alias("p95_latency_ms"))
    rate = (F.col("total") - F.col("ok")) / F.col("total")
    return (
        totals.join(ranks, keys, "left").withColumn("error_rate", rate)
        .withColumn("passed", (F.col("error_rate") <= max_error_rate) & F.coalesce(F.col("p95_latency_ms") <= max_p95_ms, F.lit(False))))


def probe_status_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys, F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n"))
