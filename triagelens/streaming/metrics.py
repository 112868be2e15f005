"""All service metrics at every evaluation step, each on its own window, from one set of partial sums.

Events are reduced once to tumbling partial sums of a step, on a table or, with a watermark, on a
stream. A second aggregate adds the partials of the last 24 hours at every step; shorter windows
are the same sum over younger partials. An event is counted once, and the second aggregate's size
depends on time and services only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from .slo import bucket_quantile, rate_ratio

STEP = 300
M5, M10, H1, H24 = 300, 600, 3600, 86400
BOUNDS = [float(b) for b in V.HISTOGRAM_BUCKETS["http_request_duration_seconds"]]
#: Gauges of answers: name of the mean and the telemetry column; events without a value count for nothing.
ANSWERS = {"faithfulness": "faithfulness", "hallucination": "hallucination", "citation_coverage": "citation_coverage",
           "evidence_score": "evidence_score", "cost_per_request": "cost_dollars"}


def _sums() -> dict[str, Column]:
    out = {
        "n": F.count(F.lit(1)), "errors": F.count_if(F.col("status") >= 500), "abstained": F.count_if(F.col("decision") == "abstain"),
        "escalated": F.count_if(F.col("decision") == "escalate"), "blocked": F.count_if("injection_blocked"), "guarded": F.count_if("guardrail"),
        "tokens": F.sum("token_count").cast("double"), "confidence": F.sum("confidence"),
    }
    for name, column in ANSWERS.items():
        out[f"{name}_sum"], out[f"{name}_n"] = F.sum(column), F.count(column)
    return out


def step_sums(events: DataFrame, watermark: str | None = None, step: int = STEP) -> DataFrame:
    """(w, service, sums, bucket counts, last breaker state) of each tumbling step."""
    src = events.withWatermark("ts", watermark) if watermark else events
    buckets = [F.count_if(F.col("duration_seconds") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    breaker = F.max_by("breaker_state", F.struct("ts", "event_id")).cast("long").alias("breaker")
    return src.groupBy(F.window("ts", f"{step} seconds").alias("w"), "service").agg(*[c.alias(k) for k, c in _sums().items()], *buckets, breaker)


def trailing_sums(partials: DataFrame, seconds: dict[str, int], names: list[str], step: int = STEP) -> DataFrame:
    """(at, service, {name}_{tag}): sums of the last ``seconds`` of each tag at the end ``at`` of every step.

    One aggregate holds all lengths; one without a partial is null. A partial is repeated by an explode: a sliding window would be
    a branch of generated code for each of its steps, which for a day of them is more than the compiler takes.
    """
    timed = partials.select(F.window_time("w").alias("t"), F.col("w.end").alias("end"), "service", *names)
    ages = F.sequence(F.lit(0), F.lit(max(seconds.values()) - step), F.lit(step))
    # the end of a step is event time as the time it is made from: it carries the same watermark
    at = F.timestamp_seconds(F.unix_timestamp("end") + F.col("age")).alias("at", metadata=timed.schema["t"].metadata)
    each = timed.select("*", F.explode(ages).alias("age")).select(at, "age", "service", *names)
    return each.groupBy("at", "service").agg(
        *[F.sum(F.when(F.col("age") < length, F.col(c))).alias(f"{c}_{tag}") for tag, length in seconds.items() for c in names])


def drift_stream(events: DataFrame, watermark: str | None = None, step: int = STEP) -> DataFrame:
    """Short against long trailing means: a windowed aggregate of partial sums, chained to one that holds both lengths.

    Steps without an event in the short window have no row.
    """
    names, seconds = ["n", "tokens", "confidence", "escalated"], {"s": H1, "l": H24}
    sums = trailing_sums(step_sums(events, watermark, step).select("w", "service", *names), seconds, names, step).where("n_s > 0")
    means = {f"{c}_{tag}": rate_ratio(F.col(f"{c}_{tag}"), F.col(f"n_{tag}"), length) for tag, length in seconds.items() for c in names[1:]}
    return sums.withColumns(means).select(
        F.col("at").alias("window_end"), "service", input_drift(F.col("tokens_s"), F.col("tokens_l")).alias("input_drift"),
        F.abs(F.col("confidence_s") - F.col("confidence_l")).alias("confidence_drift"), F.abs(F.col("escalated_s") - F.col("escalated_l")).alias("outcome_drift"))


def input_drift(short: Column, long: Column) -> Column:
    return F.abs(short - long) / F.greatest(long, F.lit(1.0))


def metric_rows(partials: DataFrame, step: int = STEP) -> DataFrame:
    """(window_end, service, metrics) at every step of the day after an event, from a table of ``step_sums``.

    A partial is repeated once for each step whose day it belongs to: 288 rows for each service
    and five minutes, however many events there were.
    """
    names = [c for c in partials.columns if c not in ("w", "service")]
    ends = F.unix_timestamp(F.col("w.end")).alias("e")
    each = partials.select(ends, "service", *names).withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(H24 - step), F.lit(step))))
    each = each.withColumn("at", F.timestamp_seconds(F.col("e") + F.col("age")))

    def over(c: str, seconds: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("age") < seconds, F.col(c))), F.lit(0)).alias(f"{c}_{seconds}")

    wanted = {
        H24: ["n", "escalated", "tokens", "confidence"],
        H1: ["n", "abstained", "escalated", "blocked", "tokens", "confidence", *[f"{a}_{x}" for a in ANSWERS for x in ("sum", "n")]],
        M10: ["guarded"],
        M5: ["n", "errors", *[f"b{i}" for i in range(len(BOUNDS))], "breaker"],
    }
    sums = each.groupBy("at", "service").agg(*[over(c, max(s, step)) for s, columns in wanted.items() for c in columns])

    def mean(c: str, seconds: int, n: str = "n") -> Column:
        return rate_ratio(F.col(f"{c}_{seconds}"), F.col(f"{n}_{seconds}"), seconds)

    short = max(M5, step)
    counts = F.array(*[F.col(f"b{i}_{short}") for i in range(len(BOUNDS))])
    error = rate_ratio(F.col(f"errors_{short}"), F.col(f"n_{short}"), short)
    return sums.select(
        F.col("at").alias("window_end"), "service", F.col(f"n_{short}").alias("n"), error.alias("error_rate"), error.alias("model_error_rate"),
        *[bucket_quantile(counts, F.col(f"n_{short}"), BOUNDS, q).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))],
        (F.col(f"n_{short}") / short).alias("throughput_5m"), (F.col(f"n_{H1}") / H1).alias("throughput_1h"),
        ((F.col(f"n_{short}") / short < 0.1) & (F.col(f"n_{H1}") / H1 > 1)).cast("double").alias("throughput_collapse"),
        mean("abstained", H1).alias("abstain_rate"), mean("escalated", H1).alias("escalation_rate"), mean("blocked", H1).alias("injection_block_rate"),
        (F.col(f"guarded_{max(M10, step)}") / max(M10, step)).alias("guardrail_rate"),
        input_drift(mean("tokens", H1), mean("tokens", H24)).alias("input_drift"),
        F.abs(mean("confidence", H1) - mean("confidence", H24)).alias("confidence_drift"),
        F.abs(mean("escalated", H1) - mean("escalated", H24)).alias("outcome_drift"),
        *[F.when(F.col(f"{a}_n_{H1}") > 0, rate_ratio(F.col(f"{a}_sum_{H1}"), F.col(f"{a}_n_{H1}"), H1)).alias(a) for a in ANSWERS],
        F.col(f"breaker_{short}").cast("double").alias("breaker_state"),
    )
