"""Decisions on a stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.decide import DecideConfig, decide_batch
from ..session import stage

OUTPUTS = ("results", "drafts", "shadow", "handoffs", "events", "audit")


def decide_each(
    chunks: DataFrame, cfg: DecideConfig, out: str, stored: DataFrame | None = None, packs: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function that writes every output of a batch below ``out``.

    The batch id names the target folders and they are overwritten, so a batch that is repeated
    after a failure leaves the same rows, wherever the first try stopped.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # read by several outputs, and a source may not give the same rows twice
        frames = decide_batch(stage(batch, "requests"), chunks, cfg, stored, packs)
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    return each


def decide_stream(
    requests: DataFrame, chunks: DataFrame, cfg: DecideConfig, out: str, stored: DataFrame | None = None, packs: DataFrame | None = None
) -> StreamingQuery:
    """Decide every micro-batch of requests against static tables; see ``decide_each``.

    Per-request rankings need whole-batch windows, so the batch plan runs in foreachBatch.
    """
    each = decide_each(chunks, cfg, out, stored, packs)
    return requests.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def decided_rows(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of ``OUTPUTS`` (or ``replayed``) of all batches so far, with their ``batch``."""
    return spark.read.parquet(f"{out}/{name}")
