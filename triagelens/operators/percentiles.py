"""Exact percentiles of weighted values without sorting or holding them.

The value at a rank is found by narrowing: the range that holds it is cut into cells, a running
count over the cells tells which one has the rank, and that cell's least and greatest value are the
next range. A round reads the counts once and keeps ``CELLS`` rows for each rank; each makes the
ranges a thousand times narrower, until a range is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

CELLS = 1024


def values_at_ranks(counts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, value) for ``ranks`` (keys, rank from 0) over ``counts`` (keys, value, n)."""
    bounds = counts.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    found = stage(ranks.join(bounds, keys).withColumn("below", F.lit(0).cast("long")), "ranges")
    while not found.where("low < high").isEmpty():
        place = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS
        cell = F.when(F.col("low") < F.col("high"), F.least(F.floor(place), F.lit(CELLS - 1))).otherwise(0).alias("cell")
        inside = counts.join(found, keys).where(F.col("value").between(F.col("low"), F.col("high")))
        cells = inside.groupBy(*keys, "rank", "below", cell).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("cell"))
        run = cells.withColumn("upto", F.col("below") + upto)
        hit = run.where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        found = stage(hit.select(*keys, "rank", "low", "high", (F.col("upto") - F.col("n")).cast("long").alias("below")), "ranges")
    return found.select(*keys, "rank", F.col("low").alias("value"))


def exact_percentiles(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, share, value): interpolated percentiles over ``counts`` (keys, value double, n), nulls left out.

    Equal to sorting all rows and going ``share`` of the way from the first to the last.
    """
    counts = stage(counts.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.sum("n").alias("n")), "value-counts")
    place = counts.groupBy(*keys).agg(F.sum("n").alias("rows")).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    place = place.withColumn("at", (F.col("rows") - 1) * F.col("share"))
    ends = place.select(*keys, "share", "at", F.floor("at").alias("first"), F.ceil("at").alias("second"))
    ranks = ends.select(*keys, F.explode(F.array("first", "second")).alias("rank")).distinct()
    values = values_at_ranks(counts, ranks, keys)
    for end, name in (("first", "v1"), ("second", "v2")):
        ends = ends.join(values.select(*keys, F.col("rank").alias(end), F.col("value").alias(name)), [*keys, end])
    return ends.select(*keys, "share", (F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("at") - F.col("first"))).alias("value"))
