"""Reading, replacing and upserting stored Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.schema(table)).parquet(f"{root}/{table}")


def replace_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the partitions that occur in ``df``; large ones are split by size."""
    (df.hint("rebalance", *keys)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def append(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*keys) if keys else w).parquet(path)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """Existing rows with incoming ones on top; the last incoming row wins.

    ``order`` numbers the incoming rows. ``keep`` columns (a creation time,
    say) stay as they were on rows that already exist. Rows reduce to the
    newest per key on the map side before the shuffle.
    """
    cols = existing.columns
    both = existing.withColumn("_gen", F.lit(0)).withColumn("_ord", F.lit(None).cast("bigint")).unionByName(
        incoming.withColumn("_gen", F.lit(1)).withColumn("_ord", F.col(order).cast("bigint")).select(*cols, "_gen", "_ord"))
    rank = F.struct("_gen", F.coalesce("_ord", F.lit(-1)))
    rest = [c for c in cols if c not in keys]
    aggs: list[Column] = [F.max_by(F.struct(*rest), rank).alias("r")]
    old = [F.min_by(F.col(c), rank).alias(f"_old_{c}") for c in keep or []]
    out = both.groupBy(*keys).agg(*aggs, *old)
    values = [F.col(f"_old_{c}").alias(c) if c in (keep or []) else F.col(f"r.{c}").alias(c) for c in rest]
    return out.select(*keys, *values).select(*cols)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new (append these)."""
    fresh = incoming.groupBy(*keys).agg(F.min(F.struct(*[c for c in incoming.columns if c not in keys])).alias("r")) if len(
        incoming.columns) > len(keys) else incoming.distinct()
    flat = fresh.select(*keys, "r.*") if "r" in fresh.columns else fresh
    return flat.join(existing.select(*keys), keys, "left_anti")


def tenant_display_name(tenant_id: Column) -> Column:
    clean = F.trim(F.translate(tenant_id, "_-", "  "))
    return F.when(clean != "", F.initcap(F.lower(clean))).otherwise(tenant_id)


def new_tenants(existing: DataFrame, rows: DataFrame) -> DataFrame:
    ids = rows.select(F.trim("tenant_id").alias("tenant_id")).filter(F.col("tenant_id") != "").distinct()
    return ids.join(existing.select("tenant_id"), "tenant_id", "left_anti").select(
        "tenant_id", tenant_display_name(F.col("tenant_id")).alias("name"), F.lit("active").alias("status"))


def tenant_scope(df: DataFrame, tenant_ids: list[str], is_admin: bool = False) -> DataFrame:
    """Rows the caller may see; admins and an empty list see every tenant."""
    return df if is_admin or not tenant_ids else df.filter(F.col("tenant_id").isin(list(tenant_ids)))


def canonical_uuid(raw: Column, scope: str) -> Column:
    """The id itself when it is a UUID, else its name-based UUID (version 5)."""
    namespace = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the URL namespace
    name = F.encode(F.concat(F.lit(f"{scope}:"), raw), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(raw.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(raw)).otherwise(made)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
