"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelens.session import released, stage

__all__ = ["buckets_by_id", "by_bucket", "keyed", "map_batches", "read", "released", "rows_again", "spread_width", "stage", "tokenizer_path"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of about 4 MB, unless the session has a size of its own.

    Rows are counted by default (10,000 a batch), which is 50 MB of whole texts, several times over in both processes.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "4m")
    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread_width(spark: SparkSession) -> int:
    """Partitions for a shuffle whose rows are heavy on CPU."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending doc_ids that cut the table into ranges of about equal row counts."""
    cuts = [k / n for k in range(1, n)]
    if not cuts:
        return []
    got = docs.agg(F.percentile_approx("doc_id", cuts, 20 * n).alias("q")).first()["q"]
    return sorted(set(got or []))


def buckets_by_id(docs: DataFrame, n: int) -> tuple[Column, int]:
    """Range number of each row by ascending doc_id (null first, in range 0), and the number of ranges.

    The number is the count of bounds below the id, by binary search in an array literal.
    """
    bounds = id_bounds(docs, n)
    if not bounds:
        return F.lit(0), 1
    array = F.lit(bounds)
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])

    def narrowed(found: Column, step: Column) -> Column:
        to = found + step
        return F.when((to <= len(bounds)) & (F.try_element_at(array, to) < F.col("doc_id")), to).otherwise(found)

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), narrowed)), len(bounds) + 1


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """One partition for each value of ``bucket``."""
    return df.repartitionById(n, F.col("bucket").cast("int"))


def rows_again(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of a table from its ``keyed`` rows (text, missing, row)."""
    text = F.when(~F.col("missing"), F.col("text")).alias("text")
    return rows.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def keyed(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(key, doc_id, text): an ascending unique long for each row, by doc_id (null first), then text.

    The key is doc_id itself where that is unique and never null; otherwise rows are numbered
    range by range. A null text is empty. Other columns go, or stay in the struct ``row``, with
    doc_id as it was, beside ``missing``, which tells null texts; see ``rows_again``.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").isNull().alias("missing")] if rows else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *kept)
    seen = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if seen["rows"] == seen["ids"]:
        # said here for every plan alike, so that inner and outer joins can share a shuffle of the texts
        return docs.where("doc_id is not null").withColumn("key", F.col("doc_id"))
    bucket, _ = buckets_by_id(docs, spread_width(docs.sparkSession))
    ranked = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    numbered = docs.withColumn("bucket", bucket.cast("long")).withColumn("nth", F.row_number().over(ranked))
    return stage(numbered.withColumn("key", F.shiftleft("bucket", 40) + F.col("nth")).drop("bucket", "nth"), "keyed")
