"""Suffix-array deduplication by a depth-limited radix sort.

Suffixes (window starts) are ordered through ``threshold`` bytes only, most significant digit
first, and a suffix whose digit is unique leaves the sort. The digits of the passes, see
``repeats``: a short anchor gram of the window and the path round it, a long one and its path,
then for suffixes still in groups the leading and the trailing half of the window. Groups equal through all digits are exactly the
repeated windows; all but the first of a group (by doc_id, then start) are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from triagelens.llm.common import keyed, map_batches, read, rows_again
from triagelens.llm.repeats import Shape, covered, with_marks
from triagelens.llm.rolling import bytes_of, chunked

THRESHOLD = 100


def shape_of(threshold: int) -> Shape:
    return Shape(threshold, tuple(sorted({max(1, threshold // 4), max(1, threshold * 17 // 20)})), False)


def marked_batches(shape: Shape, batches):
    """(row numbers, bytes, bounds, covered) for parts of the batches."""
    for batch in batches:
        data, bounds = bytes_of(batch["text"])
        marks = pc.fill_null(batch["marks"], pa.scalar([], batch["marks"].type))
        for a, b in chunked(bounds, 1 << 20):
            own = bounds[a : b + 1] - bounds[a]
            yield batch, a, b, data[bounds[a] : bounds[b]], own, covered(shape, own, marks[a:b])


def repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end in bytes) of each row of ``docs``.

    A null text is empty; rows with null or equal doc_id are ordered by text; a text under
    ``threshold`` bytes has no window; other columns are ignored.
    """
    shape = shape_of(threshold)

    def digest(batches):
        for batch, a, b, data, own, gone in marked_batches(shape, batches):
            rows = []
            for k in range(b - a):
                part = gone[own[k] : own[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).view(np.int8)))
                kept = data[own[k] : own[k + 1]]
                kept = kept[~part] if len(edges) else kept
                spans = [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)]
                rows.append((batch["doc_id"][a + k].as_py(), len(part), int(part.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            yield pa.RecordBatch.from_arrays([
                pa.array(v, t) for v, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))])
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    marked = with_marks(keyed(docs), shape).select("doc_id", "text", "marks")
    return map_batches(marked, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``, all other columns as they are.

    A span shrinks to whole characters, so what is left is valid UTF-8. Rows with nothing left
    stay, with an empty text; a null text stays null. ``n_chars``, if there, is counted anew.
    """
    shape = shape_of(threshold)
    # doc_id stays, so that this shuffle of the texts is the one that the passes made
    marked = with_marks(keyed(docs, rows=True), shape).select("doc_id", "text", "missing", "row", "marks")
    counted = "n_chars" in docs.columns

    def cut(batches):
        for batch, a, b, data, own, gone in marked_batches(shape, batches):
            if gone.any():
                # a character goes only if all its bytes do
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
            texts = pa.array([data[x:y][~gone[x:y]].tobytes().decode() for x, y in zip(own[:-1], own[1:])], pa.string())
            row, missing = batch["row"][a:b], batch["missing"][a:b]
            if counted:
                columns = dict(zip([f.name for f in row.type], row.flatten()))
                kept = columns["n_chars"]
                columns["n_chars"] = pc.if_else(missing, kept, pc.utf8_length(texts).cast(kept.type))
                row = pa.StructArray.from_arrays(list(columns.values()), fields=list(row.type))
            yield pa.RecordBatch.from_arrays([texts, missing, row], names=["text", "missing", "row"])

    return rows_again(map_batches(marked, cut, marked.select("text", "missing", "row").schema), docs.columns)


def op10_radix_suffixes(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(read(spark, sf_dir, "documents")).drop("spans")
