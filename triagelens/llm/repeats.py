"""Windows that also start earlier, found by compacted paths and sorted digits.

Windows are ``length`` consecutive units (bytes or words) of one document. Every window names
its anchor: the least hashed gram of ``gram`` units in it. Neighbouring windows with one anchor
form a path, about ``length - gram`` windows long. Equal windows lie in paths with equal anchors,
and paths of equal content hold equal windows.

1. Each task turns its documents into paths. One shuffle by anchor sorts them by (anchor, path,
   document, start): an anchor seen once drops out with all its windows; a path that came
   earlier is removed as a whole; an anchor with one path alone needs no more.
2. Where an anchor has several paths (a branch), the first occurrence of each goes to the next
   pass with longer grams, so shorter paths, and in the last pass to single windows, sorted by
   two digits. The first occurrence of a window lies in the first occurrence of its path, so
   nothing else has to be compared.

A task keeps only the first of equal paths or windows among the documents it has at hand and
reports the others at once, so a passage in a third of all documents sends a row or so a task.
Hashes are 64-bit pairs (anchor and path, or two digits) of separate polynomials.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import map_batches, spread_width, stage
from triagelens.llm.rolling import Rolling, byte_values, bytes_of, chunked, mix, window_min, word_spans

#: Bytes of documents that a task has at hand at once; about 100 bytes of memory each.
CHUNK = 1 << 20
PLACE = np.uint64((1 << 28) - 1)
ROWS = "p long, s long, key long, start int, n int"
MARKS = "key long, start int, n int, branch boolean"


@dataclass(frozen=True)
class Shape:
    """Window length in units, words or bytes, and the grams of the passes, ascending."""

    length: int
    grams: tuple[int, ...]
    words: bool


def unit_values(shape: Shape, data: np.ndarray, bounds: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each unit, and the units before each document's end."""
    if not shape.words:
        return byte_values(which)[data], bounds
    starts, ends, upto = word_spans(data, bounds)
    return Rolling(byte_values(which)[data], which).at(starts, ends - starts), upto


def first_of(p: np.ndarray, s: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows are the first of their (p, s) by (key, start)."""
    order = np.lexsort((start, key, s, p))
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[order][1:] != p[order][:-1]) | (s[order][1:] != s[order][:-1])
    out = np.zeros(len(p), bool)
    out[order[fresh]] = True
    return out


def table(p, s, key, start, n) -> pa.RecordBatch:
    """Rows to compare; n below zero passes a mark through."""
    return pa.RecordBatch.from_arrays([
        pa.array(p.view(np.int64)), pa.array(s.view(np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
    ], names=["p", "s", "key", "start", "n"])


def compared(p, s, key, start, n) -> pa.RecordBatch:
    """The first of equal rows to compare, the others as marks dealt out by document."""
    first = first_of(p, s, key, start)
    p = np.where(first, p, mix(key.view(np.uint64)))
    return table(p, np.where(first, s, np.uint64(0)), key, start, np.where(first, n, -n))


def chosen(shape: Shape, upto: np.ndarray, marks) -> np.ndarray:
    """Which units begin a window that is looked at: all that fit, or those in ``marks`` (as in ``covered``)."""
    if marks is not None:
        return covered(shape, upto, marks, 1)
    change = np.zeros(upto[-1] + 1, np.int64)
    many = np.diff(upto) >= shape.length
    np.add.at(change, upto[:-1][many], 1)
    np.add.at(change, upto[1:][many] - shape.length + 1, -1)
    return np.cumsum(change[:-1]) > 0


def paths(shape: Shape, gram: int, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, marks=None):
    """Anchor, path hash, key, start and number of windows of each path."""
    values, upto = unit_values(shape, data, bounds, 0)
    grams = Rolling(values, 0).every(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = window_min((grams & ~PLACE) | place, shape.length - gram + 1) & PLACE
    begins = chosen(shape, upto, marks)[: len(least)]
    fresh = begins.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~begins[:-1]
    edge = upto[:-1][upto[:-1] < len(least)]
    fresh[edge] = begins[edge]
    starts = np.flatnonzero(fresh)
    # a path ends where the next begins or where the chosen windows end
    upward = np.cumsum(begins)
    n = np.diff(np.append(upward[starts] - 1, upward[-1] if len(upward) else 0))
    doc = np.searchsorted(upto, starts, "right") - 1
    other, _ = unit_values(shape, data, bounds, 1)
    whole = Rolling(other, 1).at(starts, n + shape.length - 1)
    return grams[least[starts].astype(np.int64)], whole, keys[doc], starts - upto[doc], n


def windows(shape: Shape, data, bounds, keys, marks):
    """Two digits, key and start of each marked window: the hashes of its halves."""
    first, upto = unit_values(shape, data, bounds, 0)
    second, _ = unit_values(shape, data, bounds, 1)
    at = np.flatnonzero(chosen(shape, upto, marks))
    half = shape.length // 2
    d1 = Rolling(first, 0).at(at, half)
    d2 = Rolling(second, 1).at(at + half, shape.length - half)
    doc = np.searchsorted(upto, at, "right") - 1
    return d1, d2, keys[doc], at - upto[doc], np.ones(len(at), np.int64)


def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of rows sorted by (p, s, key, start); a p that has several s marks their first rows as branches.

    Only the last p and s and at most one row are kept between batches.
    """
    last_p = last_s = held = None
    for batch in batches:
        p, s, key, start, n = (batch[c].to_numpy() for c in ("p", "s", "key", "start", "n"))
        parts = [(key[n < 0], start[n < 0], -n[n < 0], False)]
        p, s, key, start, n = (x[n > 0] for x in (p, s, key, start, n))
        if len(p):
            new_p, new_s = np.ones(len(p), bool), np.ones(len(p), bool)
            new_p[1:] = p[1:] != p[:-1]
            new_s[1:] = new_p[1:] | (s[1:] != s[:-1])
            new_p[0] = last_p is None or p[0] != last_p
            new_s[0] = new_p[0] or s[0] != last_s
            parts.append((key[~new_s], start[~new_s], n[~new_s], False))
            reps = np.flatnonzero(new_s)
            if len(reps):
                more = ~new_p[reps]
                if more[0] and held is not None:
                    parts.append((*held, True))
                forks = reps[more | np.append(more[1:], False)]
                parts.append((key[forks], start[forks], n[forks], True))
                end = reps[-1:]
                held = (key[end], start[end], n[end]) if new_p[end[0]] else None
            last_p, last_s = p[-1], s[-1]
        yield pa.RecordBatch.from_arrays([
            *(pa.array(np.concatenate([x[i] for x in parts]), t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))),
            pa.array(np.concatenate([np.full(len(x[0]), x[3]) for x in parts])),
        ], names=["key", "start", "n", "branch"])


def sorted_marks(rows: DataFrame, n: int) -> DataFrame:
    return map_batches(rows.repartition(n, "p").sortWithinPartitions("p", "s", "key", "start"), earlier, MARKS)


def removed_windows(docs: DataFrame, shape: Shape) -> DataFrame:
    """(key, start, n): runs of windows of ``docs`` (key, text and more) that also start earlier."""
    n = spread_width(docs.sparkSession)

    def task(gram: int | None):
        def run(batches):
            for batch in batches:
                data, bounds = bytes_of(batch["text"])
                keys = batch["key"].to_numpy()
                marks = batch["marks"] if "marks" in batch.schema.names else None
                for a, b in chunked(bounds, CHUNK):
                    part = (data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], keys[a:b])
                    here = None if marks is None else marks[a:b]
                    yield compared(*(windows(shape, *part, here) if gram is None else paths(shape, gram, *part, here)))

        return run

    found = stage(sorted_marks(map_batches(docs.select("key", "text"), task(shape.grams[0]), ROWS), n), "paths")
    out = found.where("not branch")
    for gram in (*shape.grams[1:], None):
        # all columns of the documents go along, so that every pass and the caller share one shuffle of them;
        # the marks of a pass are read twice from one shuffle
        branches = found.where("branch").groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
        found = sorted_marks(map_batches(docs.join(branches, "key"), task(gram), ROWS), n)
        out = out.unionByName(found.where("not branch"))
    return out.select("key", "start", "n")


def with_marks(docs: DataFrame, shape: Shape) -> DataFrame:
    """``docs`` (key, text and more) with ``marks``, the runs of windows to remove (null: none)."""
    marks = removed_windows(docs, shape).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return docs.join(marks, "key", "left")


def covered(shape: Shape, upto: np.ndarray, marks, length: int | None = None) -> np.ndarray:
    """Which units lie in a marked window, or in its first ``length`` units. ``marks``: Arrow list of (start, n) for each document."""
    ends = marks.offsets.to_numpy().astype(np.int64)
    start, n = (marks.values.field(k).to_numpy().astype(np.int64)[ends[0] : ends[-1]] for k in (0, 1))
    start = start + upto[np.repeat(np.arange(len(upto) - 1), np.diff(ends))]
    change = np.zeros(upto[-1] + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n + (length or shape.length) - 1, -1)
    return np.cumsum(change[:-1]) > 0
