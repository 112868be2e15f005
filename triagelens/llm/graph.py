"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node it can reach.

    Each round moves neighbours to the least node next to them, written to the shared folder;
    the number of rounds follows from the logarithm of the longest path, and one node's
    neighbours are only ever reduced to their minimum, never gathered.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "edges")
    mark = signature(e)
    while True:
        ends = e.select(F.col("v").alias("y"), F.col("u").alias("o")).unionByName(e.select(F.col("u").alias("y"), F.col("v").alias("o")))
        least = ends.groupBy("y").agg(F.min("o").alias("m")).select(F.col("y").alias("v"), F.least("y", "m").alias("m"))
        large = e.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = stage(small.select("e.*").where("u <> v").distinct(), "edges")
        before, mark = mark, signature(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
