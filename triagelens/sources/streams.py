"""Streaming readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """File stream of a Parquet folder; the schema is that of the files there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)
