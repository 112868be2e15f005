"""Cell index over unit vectors: coarse centres, cells as partitions of a stored table, exact rerank.

The index is a table of (chunk_id, tenant_id, section, c_vec) partitioned by ``cell``, with the
centres in a second table beside it. A search reads only the cells whose centres are nearest to
each request and scores their rows exactly, so its cost is requests x probed rows; how many
neighbours that finds is measured against the exact search (``recall``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from .retrieval import BLOCK_ROWS, block_search, cosine_matrix

#: Rows that centres are trained on, those with the least MD5 of their id; and the most centres, which go to every task.
SAMPLE, CELLS = 1 << 16, 4096


@dataclass(frozen=True)
class CellIndex:
    centres: np.ndarray
    rows: DataFrame


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centres of greatest inner product for each vector, ties by number."""
    scores = np.round(vectors @ centres.T, 9)
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def train_centres(vectors: DataFrame, key: str, vec: str, cells: int, rounds: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres from a bounded sample: its first rows, then ``rounds`` of means of the nearest."""
    if cells > CELLS:
        raise ValueError(f"at most {CELLS} cells")
    drawn = vectors.select(key, vec).orderBy(F.md5(F.col(key)), key).limit(max(sample, cells)).toPandas()[vec]
    if drawn.empty:
        return np.zeros((1, 1))
    rows = np.stack(drawn.to_numpy())
    centres = rows[:cells].copy()
    for _ in range(rounds):
        at = nearest(rows, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        size = np.linalg.norm(sums, axis=1)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
    return centres


def cells_of(vec: Column, centres: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` nearest cells, nearest first."""

    @F.pandas_udf("array<int>")
    def number(column: pd.Series) -> pd.Series:
        if column.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(nearest(np.stack(column.to_numpy()), centres, n).astype(np.int32)))

    return number(vec)


def build_index(chunks: DataFrame, cells: int, rounds: int = 1, path: str | None = None) -> CellIndex:
    """Train on and store ``chunks`` (chunk_id, tenant_id, section, c_vec); every row is indexed.

    ``path`` defaults to a new folder below the shared one; ``open_index`` reads it again.
    """
    spark = chunks.sparkSession
    path = path or work_path(spark, "cells")
    centres = train_centres(chunks, "chunk_id", "c_vec", cells, rounds)
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    placed = chunks.select("chunk_id", "tenant_id", "section", "c_vec", F.get(cells_of(F.col("c_vec"), centres, 1), F.lit(0)).alias("cell"))
    # rows of a cell are dealt over several tasks by id, so that a crowded cell is no single file
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"]
    schema = "chunk_id string, tenant_id string, section string, c_vec array<double>, cell int"
    return CellIndex(np.stack(centres.to_numpy()), spark.read.schema(schema).parquet(f"{path}/rows"))


def index_search(requests: DataFrame, index: CellIndex, k: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k by cosine within the scope among the rows of each request's ``probes`` nearest cells.

    ``requests`` has request_id, tenant_id, scope and q_vec. Groups are parts of a cell of one
    tenant, so neither a scope nor a crowded cell is ever in one task.
    """
    probed = requests.select("request_id", "tenant_id", "scope", "q_vec", F.explode(cells_of(F.col("q_vec"), index.centres, probes)).alias("cell"))
    found = block_search(
        probed, index.rows, "vec", k, cosine_matrix, "request_id string, chunk_id string, score double", block_rows, within=("cell",))
    return found.withColumnRenamed("score", "dense_score")


def recall(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Share of the true (request_id, chunk_id) rows of ``truth`` that ``found`` holds, for each ``by``."""
    hits = found.select("request_id", "chunk_id", F.lit(1).alias("hit"))
    joined = truth.join(hits, ["request_id", "chunk_id"], "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))
