"""Sliding-window service metrics; the same functions run on streams and tables.

Telemetry rows carry ts (TIMESTAMP), service, status, decision, stage,
duration_seconds, confidence, token_count, injection_blocked, guardrail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..session import ROCKSDB_PROVIDER, work_path

RATE_FLOOR = 0.001  # fixed value: smallest denominator of a rate


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def rate_ratio(num: Column, den: Column, seconds: int) -> Column:
    return (num / seconds) / F.greatest(den / seconds, F.lit(RATE_FLOOR))


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.count_if(F.col("decision") == "abstain").alias("abstained"),
        F.count_if(F.col("decision") == "escalate").alias("escalated"),
        F.count_if("injection_blocked").alias("blocked"),
        F.count_if("guardrail").alias("guarded"),
        F.sum("token_count").cast("double").alias("tokens"),
        F.sum("confidence").alias("confidence"),
        F.sum("duration_seconds").alias("duration"),
    ]


def window_sums(events: DataFrame, duration: str, slide: str, keys: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """Sums per sliding window; with a watermark the result can be appended."""
    src = events.withWatermark("ts", watermark) if watermark else events
    return src.groupBy(F.window("ts", duration, slide).alias("w"), *(keys or ["service"])).agg(*_sums()).select(
        F.col("w.end").alias("window_end"), *(keys or ["service"]),
        "n", "errors", "abstained", "escalated", "blocked", "guarded", "tokens", "confidence", "duration")


def rates(sums: DataFrame, seconds: int) -> DataFrame:
    """Error, availability, throughput, outcome and mean metrics of window sums."""
    def mean(c: str) -> Column:
        return rate_ratio(F.col(c), F.col("n"), seconds)

    return sums.withColumns({
        "error_rate": mean("errors"), "availability": F.lit(1.0) - mean("errors"), "throughput_rps": F.col("n") / seconds,
        "abstain_rate": mean("abstained"), "escalation_rate": mean("escalated"), "injection_block_rate": mean("blocked"),
        "guardrail_rate": F.col("guarded") / seconds, "token_mean": mean("tokens"), "confidence_mean": mean("confidence"),
        "duration_mean": mean("duration"),
    }).drop("errors", "abstained", "escalated", "blocked", "guarded", "tokens", "confidence", "duration")


def bucket_quantile(counts: Column, total: Column, bounds: list[float], q: float) -> Column:
    """Quantile from cumulative bucket counts, linear inside the bucket.

    Beyond the last bound the last bound is returned.
    """
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    rank = total * q
    position = F.size(F.filter(counts, lambda c: c < rank))

    def inside(i: Column) -> Column:
        below = F.when(i > 0, F.get(counts, i - 1)).otherwise(0)
        low = F.when(i > 0, F.get(edges, i - 1)).otherwise(0.0)
        width = F.nullif((F.get(counts, i) - below).cast("double"), F.lit(0.0))
        return low + (F.get(edges, i) - low) * F.coalesce((rank - below) / width, F.lit(0.0))

    return F.when(total > 0, F.when(position >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside(position)))


def latency_quantiles(events: DataFrame, duration: str, slide: str, keys: list[str], watermark: str | None = None,
                      histogram: str = "http_request_duration_seconds") -> DataFrame:
    """p50 / p95 / p99 per sliding window from bucket counts."""
    bounds = V.HISTOGRAM_BUCKETS[histogram]
    src = events.withWatermark("ts", watermark) if watermark else events
    v = F.col("duration_seconds")
    agg = src.groupBy(F.window("ts", duration, slide).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(v <= float(b)).alias(f"_b{i}") for i, b in enumerate(bounds)])
    counts = F.array(*[F.col(f"_b{i}") for i in range(len(bounds))])
    return agg.withColumn("_c", counts).select(
        F.col("w.end").alias("window_end"), *keys, "n",
        *[bucket_quantile(F.col("_c"), F.col("n"), bounds, q).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


# -- running ----------------------------------------------------------------


def run_available(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run an append stream over what is there now and read its output table.

    State of several columns needs the RocksDB store, so the stream starts with it whatever the
    session has; the session's own setting is put back.
    """
    spark = stream.sparkSession
    out = path or work_path(spark, name)
    had = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB_PROVIDER)
    try:
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if had is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, had)
    return spark.read.schema(stream.schema).parquet(out)
