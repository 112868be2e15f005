"""Hard-negative mining with bounds along a spanning tree of anchors.

For each anchor its best rows of the same label are positives; for each positive the best rows of
another label, whose score lies in a window below the positive's, are negatives. Scores are
integer inner products.

Anchors are taken in blocks of bounded size. A block's anchors form a minimum spanning tree by
distance. Every task scores the root with its rows; a child c of p has, for a row x,
``score(c, x) = score(p, x) + (c - p)x``, so by Cauchy and Schwarz its score lies within
``|c - p| |x|`` of its parent's. Only rows whose interval reaches what the child still looks for
are scored exactly; the others hand their interval, widened, down the tree. The first pass over
the rows looks for positives (at least the score of the worst of the best so far), the second for
rows inside the windows of the positives. Both leave a few rows for each anchor and task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import map_batches, read, stage

#: Most anchors, and most components of anchors together, in a block: what the driver and a broadcast hold.
ANCHORS, COMPONENTS = 4096, 1 << 20
#: Rows scored at once.
ROWS = 4096
#: Largest norm, so that all sums are exact in 64 bits.
NORM = float(1 << 31)


class Tree:
    """Minimum spanning tree of a block of anchors, in an order that keeps few intervals alive."""

    def __init__(self, vectors: np.ndarray):
        m = len(vectors)
        self.parent = np.full(m, -1)
        self.edge = np.zeros(m)
        exact = vectors.astype(np.float64)
        squares = (exact * exact).sum(1)
        least, via, left = np.full(m, np.inf), np.zeros(m, np.int64), np.ones(m, bool)
        at = 0
        for _ in range(m):
            left[at] = False
            apart = np.maximum(squares + squares[at] - 2 * (exact @ exact[at]), 0)
            nearer = left & (apart < least)
            least[nearer], via[nearer] = apart[nearer], at
            if not left.any():
                break
            at = int(np.argmin(np.where(left, least, np.inf)))
            self.parent[at] = via[at]
            self.edge[at] = np.sqrt(((exact[at] - exact[via[at]]) ** 2).sum())
        children: list[list[int]] = [[] for _ in range(m)]
        for c in range(m):
            if self.parent[c] >= 0:
                children[self.parent[c]].append(c)
        # sizes of subtrees, from the leaves up; the largest child comes last, when its parent is no longer needed
        size, found, queue = np.ones(m, np.int64), [], [0] if m else []
        while queue:
            at = queue.pop()
            found.append(at)
            queue += children[at]
        for at in reversed(found):
            if self.parent[at] >= 0:
                size[self.parent[at]] += size[at]
        self.order, queue = [], [0] if m else []
        while queue:
            at = queue.pop()
            self.order.append(at)
            queue += sorted(children[at], key=lambda c: -size[c])
        self.children = np.array([len(c) for c in children])


def intervals(tree: Tree, anchors: np.ndarray, vectors: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores) of those rows whose bounds ``wanted(anchor, low, high)`` asks for."""
    fits = np.abs(anchors).sum(1).max(initial=0) * np.abs(vectors).max(initial=0) < 2**52
    kind = np.float64 if fits else np.int64
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    if max(norms.max(initial=0), np.sqrt((anchors.astype(np.float64) ** 2).sum(1)).max(initial=0)) > NORM:
        raise ValueError("vector too long for exact scores")
    anchors, rows = anchors.astype(kind), vectors.astype(kind)
    alive: dict[int, list] = {}
    for at in tree.order:
        p = tree.parent[at]
        if p < 0:
            low = high = (rows @ anchors[at]).astype(np.float64)
            reach = 0.0
        else:
            low, high, waiting = alive[p]
            alive[p][2] -= 1
            if waiting == 1:
                del alive[p]
            reach = tree.edge[at] * norms
        # rounding of norms, sums and large scores is far below this slack
        reach = reach * (1 + 1e-9) + 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1e-3
        low, high = low - reach, high + reach
        asked = np.flatnonzero(wanted(at, low, high))
        if 4 * len(asked) > len(rows):
            scores = (rows @ anchors[at])[asked].astype(np.int64)
        else:
            scores = (rows[asked] @ anchors[at]).astype(np.int64)
        low[asked] = high[asked] = scores
        if tree.children[at]:
            alive[at] = [low, high, int(tree.children[at])]
        if len(asked):
            yield at, asked, scores


class Best:
    """The ``k`` best (score, then smallest id) for each of several keys."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps.setdefault(key, [])
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        for entry in zip(scores.tolist(), (-ids).tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def floor(self, key) -> float:
        """A row below this score is not among the best."""
        heap = self.heaps.get(key, ())
        return heap[0][0] if len(heap) == self.k else -np.inf


def rows_of(batches, width: int):
    """(ids, labels, vectors padded with zeros to ``width``) for at most ``ROWS`` rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            yield part["id"].to_numpy(), part["label"].to_numpy(), padded(part["vector"], width)


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as a matrix; shorter ones end in zeros."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def positives_in(tree: Tree, ids, labels, anchors, k: int):
    """Task: the best ``k`` rows of the same label for each anchor of a block."""

    def run(batches):
        best = Best(k)
        for own, kinds, vectors in rows_of(batches, anchors.shape[1]):

            def wanted(at, low, high):
                return (high >= best.floor(at)) & (kinds == labels[at]) & (own != ids[at])

            for at, asked, scores in intervals(tree, anchors, vectors, wanted):
                best.add(at, scores, own[asked])
        yield batch_of([(int(ids[at]), -i, s) for at, heap in best.heaps.items() for s, i in heap], ["anchor", "positive", "score"])

    return run


def negatives_in(tree: Tree, ids, labels, anchors, positives: dict[int, list[tuple[int, int]]], k: int, share: tuple[int, int]):
    """Task: the best ``k`` rows of another label in the window of each (anchor, positive)."""
    low_share, whole = share
    # the least and greatest score that any positive of an anchor lets in
    spans = {}
    for at, of in positives.items():
        bounds = [(-(-low_share * s // whole), s) for _, s in of if low_share * s <= whole * s]
        spans[at] = (min(b[0] for b in bounds), max(b[1] for b in bounds)) if bounds else None

    def run(batches):
        best = Best(k)
        for own, kinds, vectors in rows_of(batches, anchors.shape[1]):

            def wanted(at, low, high):
                span = spans.get(at)
                if span is None:
                    return np.zeros(len(own), bool)
                return (high >= span[0]) & (low <= span[1]) & (kinds != labels[at])

            for at, asked, scores in intervals(tree, anchors, vectors, wanted):
                of = positives.get(at, ()) if spans.get(at) else ()
                for positive, score in of:
                    inside = (scores >= -(-low_share * score // whole)) & (scores <= score)
                    if inside.any():
                        best.add((at, positive, score), scores[inside], own[asked][inside])
        rows = [(int(ids[at]), p, -i, s, ps) for (at, p, ps), heap in best.heaps.items() for s, i in heap]
        yield batch_of(rows, ["anchor_id", "positive_id", "negative_id", "negative_score", "positive_score"])

    return run


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def first_rows(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` first rows of each key by descending score, then ``tie``, with their ``rank``; tasks left ``k`` for each key at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks_of(rows: DataFrame, most: int) -> Iterator[pa.Table]:
    """``rows`` (id, label, vector) by ascending id, at most ``most`` at a time."""
    part = rows
    while True:
        block = part.orderBy("id").limit(most).toArrow().combine_chunks()
        if len(block):
            yield block
        if len(block) < most:
            return
        part = rows.where(F.col("id") > block["id"][-1].as_py())


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (id, label, vector of longs).

    A score is the inner product; the shorter of two vectors counts as ending in zeros. An anchor
    (rows where ``is_anchor``) has as positives its first ``positives`` other rows of the same
    label by descending score, then id; each has as negatives its first ``negatives`` rows of
    another label with ``share[0] * positive <= share[1] * negative <= share[1] * positive``, all
    if fewer; no row where there is none, as with a positive of negative score. Rows with a null
    id, label or vector take no part; of rows with one id the least by label, then vector, stays.
    Other columns are ignored; an empty table gives no rows. A vector longer than 2 ** 31 is an
    error, as sums would no longer be exact.

    Anchors are scored against all rows in blocks of at most ``anchors``, one after the other:
    the driver and a broadcast hold one block and its positives, a task a few thousand rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector").dropna()
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).first()
    if seen["n"] != seen["ids"]:
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")
    rows = stage(rows, "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    schema = "anchor_id long, positive_id long, negative_id long, negative_score long, positive_score long"
    out = spark.createDataFrame([], f"{schema}, rank int")
    for block in blocks_of(rows.where(is_anchor), max(1, min(anchors, COMPONENTS // max(1, width)))):
        ids, labels = block["id"].to_numpy(), block["label"].to_numpy()
        vectors = padded(block["vector"].combine_chunks(), width)
        tree = Tree(vectors)
        found = map_batches(rows, positives_in(tree, ids, labels, vectors, positives), "anchor long, positive long, score long")
        place = {int(i): k for k, i in enumerate(ids)}
        held: dict[int, list[tuple[int, int]]] = {}
        for r in first_rows(found, ["anchor"], "score", "positive", positives).collect():  # positives times a block at most
            held.setdefault(place[r["anchor"]], []).append((r["positive"], r["score"]))
        found = map_batches(rows, negatives_in(tree, ids, labels, vectors, held, negatives, share), schema)
        got = first_rows(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
        out = out.unionByName(stage(got, "negatives"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_components(vector: Column) -> Column:
    """floor(256 x) of each component as long; null if any is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * 256)))


def op11_anchor_tree_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings`` among all its rows; see ``mine`` for nulls, ties,
    repeated rows, clashing columns and empty tables. A component that is null or not finite takes its row out."""
    table = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), whole_components(F.col("embedding")).alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank",
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY "rank" <= 5
"""
