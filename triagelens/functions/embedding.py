"""Deterministic hash embeddings and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import plain_tokens


def token_slot(token: Column, dim: int) -> tuple[Column, Column]:
    """Vector position and signed weight of a token, from its SHA-256."""
    h = F.sha2(token, 256)
    index = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)
    weight = F.lit(1.0) + F.conv(F.substring(h, 11, 2), 16, 10).cast("double") / 255.0
    return index, sign * weight


def embed(df: DataFrame, key: list[str], text_col: str, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Unit vectors per key; texts without tokens get the zero vector.

    Counts tokens per text before hashing, so each distinct token of a text is
    hashed once, then sums by (key, position). ``dim`` values per text remain
    for the final gather.
    """
    tokens = df.select(*key, F.explode_outer(plain_tokens(F.col(text_col))).alias("token"))
    counted = tokens.groupBy(*key, "token").agg(F.count("token").alias("n"))
    index, weight = token_slot(F.col("token"), dim)
    slots = counted.select(*key, index.alias("i"), (weight * F.col("n")).alias("w"))
    summed = slots.groupBy(*key, "i").agg(F.sum("w").alias("w"))
    cells = F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "w"))))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i.cast("bigint")], F.lit(0.0)))
    per = summed.groupBy(*key).agg(cells.alias("_m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    raw = per.select(*key, vec.alias("_v"), F.coalesce("_n", F.lit(0.0)).alias("_n"))
    return raw.select(
        *key, F.when(F.col("_n") > 0, F.transform("_v", lambda v: v / F.col("_n"))).otherwise(F.col("_v")).alias(out))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    return F.transform(a, lambda v: v.cast("double") / F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0)))
