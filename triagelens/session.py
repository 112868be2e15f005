"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "triagelens", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRIAGELENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_BASE: str | None = None


def work_base(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may do
    without: all its tasks share one machine, so a temporary folder is visible
    to every one of them.
    """
    global _LOCAL_BASE
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _LOCAL_BASE is None:
        _LOCAL_BASE = tempfile.mkdtemp(prefix="triagelens-")
    return _LOCAL_BASE


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_base(spark)}/triagelens/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and lets several consumers share one computation; the files
    outlive a lost executor. The shuffles of the write are dropped at its end.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    had = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if had is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, had)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def released(result: Callable[[], DataFrame], name: str) -> DataFrame:
    """``result()`` staged, and all that was staged to make it deleted.

    For a result that is small against its intermediate tables; nothing else may still read those.
    """
    _SCOPES.append([])
    try:
        df = result()
        spark = df.sparkSession
        out = stage(df, name)
    finally:
        spent = _SCOPES.pop()
    *spent, kept = spent
    if _SCOPES:
        _SCOPES[-1].append(kept)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    for path in spent:
        old = paths(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    For CPU-heavy text work on few large files. A table with many splits comes
    back unchanged, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for steps that are heavy on CPU but light on bytes.

    Given explicitly, it keeps adaptive execution from merging them by size.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
