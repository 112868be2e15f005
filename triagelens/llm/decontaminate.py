"""Benchmark decontamination by the q-gram lemma.

An item is found where any stretch of ``WINDOW`` bytes of it (a shorter item as a whole), begun
at any byte, is in a text with few edits. A text region within e edits of a stretch of m bytes
shares at least ``m - q + 1 - q e`` q-grams with it, on diagonals (text place less item place)
that lie within e of each other. So the q-grams that a text shares with an item are taken in
bands of 2 (e + 1) diagonals that overlap by half; where as many as the bound have places in
the item within one stretch, banded alignment of all stretches around verifies them.

Items come to the tasks in blocks of bounded size, broadcast one after another, so a benchmark
of any size is searched; documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import map_batches, read
from triagelens.llm.rolling import bytes_of, chunked

Q = 10
#: Edits allowed in a window, as a share of its bytes.
RATE = 0.05
WINDOW, STRIDE = 100, 50
BLOCK_BYTES = 4 << 20
#: Stretches aligned at once.
PIECE = 1 << 14
SLOT_BITS = 22
TURN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """Q-grams of a block of items: sorted codes, and the item and place of each."""

    items: list[tuple[int | None, bytes, int]]  # id, bytes, edits in a stretch
    codes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    taken: np.ndarray  # hashed codes that occur


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """One 64-bit code for the Q bytes from each place on (eight bytes as they are, two more folded in)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole = np.lib.stride_tricks.sliding_window_view(data, 8)
    first = np.ascontiguousarray(whole[:n]).view(np.uint64).ravel()
    return first * TURN + (data[8 : 8 + n].astype(np.uint64) << np.uint64(8) | data[9 : 9 + n])


def item_windows(text: str) -> list[bytes]:
    """Stretches of an item at a stride, to test with; the search takes those at every byte."""
    raw = lowered(np.frombuffer(text.encode(), np.uint8)).tobytes()
    if len(raw) <= WINDOW:
        return [raw]
    starts = [*range(0, len(raw) - WINDOW, STRIDE), len(raw) - WINDOW]
    return [raw[s : s + WINDOW] for s in starts]


def edits_of(m: int) -> int:
    """Edit budget of a window: its share, as far as the lemma still asks for one shared q-gram."""
    return min(int(RATE * m), (m - Q) // Q)


def build(items: list[tuple[int | None, str]]) -> Index:
    raw = [(k, lowered(np.frombuffer(text.encode(), np.uint8)).tobytes()) for k, text in items]
    held = [(k, w, edits_of(min(len(w), WINDOW))) for k, w in raw if len(w) >= Q]
    codes = [grams(np.frombuffer(w, np.uint8)) for _, w, _ in held]
    sizes = [len(c) for c in codes]
    code = np.concatenate([*codes, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(code, kind="stable")
    taken = np.zeros(1 << SLOT_BITS, bool)
    taken[slot(code)] = True
    return Index(held, code[order], owner[order], place[order], taken)


def slot(code: np.ndarray) -> np.ndarray:
    return ((code * TURN) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def stretches_in(item: np.ndarray, size: int, text: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each stretch of ``size`` bytes of ``item`` to any slice of ``text``, and where that slice ends.

    Only diagonals (text place less item place) ``first`` to ``first + width`` are filled, all stretches at once.
    """
    n = len(item) - size + 1
    far = np.int32(size + 1)
    across = np.arange(width + 1, dtype=np.int32)
    # text place of each diagonal at each item place
    at = first + across + np.arange(len(item) + 1)[:, None]
    there = (at >= 0) & (at <= len(text))
    differ = np.ones((len(item), width + 1), np.int32)
    inside = (at[:-1] >= 0) & (at[:-1] < len(text))
    differ[inside] = (text[at[:-1][inside]] != np.broadcast_to(item[:, None], differ.shape)[inside])
    row = np.where(there[:n], np.int32(0), far)
    for i in range(size):
        now = row + differ[i : i + n]
        now[:, :-1] = np.minimum(now[:, :-1], row[:, 1:] + 1)
        now[~there[i + 1 : i + 1 + n]] = far
        # further bytes of the text alone: one edit for each diagonal onward
        now = np.minimum.accumulate(now - across, axis=1) + across
        now[~there[i + 1 : i + 1 + n]] = far
        row = np.minimum(now, far)
    best = row.argmin(1)
    return row[np.arange(n), best], at[size : size + n][np.arange(n), best]


def search(index: Index, data: np.ndarray, bounds: np.ndarray):
    """(text, item, start, end, edits) of each verified stretch in texts given as bytes in a row."""
    data = lowered(data)
    code = grams(data)
    at = np.flatnonzero(index.taken[slot(code)])
    code = code[at]
    lo = np.searchsorted(index.codes, code, "left")
    keep = (lo < len(index.codes)) & (index.codes[np.minimum(lo, len(index.codes) - 1)] == code) if len(index.codes) else np.zeros(len(lo), bool)
    at, code, lo = at[keep], code[keep], lo[keep]
    n = np.searchsorted(index.codes, code, "right") - lo
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + Q <= bounds[doc + 1]
    at, which, doc = at[inside], which[inside], doc[inside]
    owner = index.owner[which]
    if not len(at):
        return
    edits = np.array([w[2] for w in index.items], np.int64)
    length = np.array([len(w[1]) for w in index.items], np.int64)
    place = index.place[which]
    # diagonals are counted from where an item that ends before its text would begin
    band = (at - bounds[doc] - place + length[owner]) // (edits[owner] + 1)
    doc, owner, place = (np.concatenate([x, x]) for x in (doc, owner, place))
    band = np.concatenate([band, np.maximum(band - 1, 0)])
    order = np.lexsort((place, band, owner, doc))
    doc, owner, band, place = doc[order], owner[order], band[order], place[order]
    edge = np.ones(len(doc), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])
    group = np.cumsum(edge) - 1
    # as many as the bound, from this one on, within the q-gram places of one stretch
    size = np.minimum(length, WINDOW)
    last = np.arange(len(doc)) + (size - Q - Q * edits)[owner]
    ends = np.minimum(last, len(doc) - 1)
    good = (last < len(doc)) & (group[ends] == group) & (place[ends] - place <= size[owner] - Q)
    good = np.flatnonzero(good)
    begins = np.split(good, np.flatnonzero(np.diff(group[good])) + 1) if len(good) else []
    for own in begins:
        k, d = int(owner[own[0]]), int(doc[own[0]])
        item, pattern, most = index.items[k]
        pattern, m = np.frombuffer(pattern, np.uint8), int(size[k])
        text = data[bounds[d] : bounds[d + 1]]
        # two neighbouring bands of diagonals, and the budget on each side
        first = int(band[own[0]]) * (most + 1) - len(pattern) - most
        width = 2 * (most + 1) + 2 * most
        # the stretches that hold all of one such run of q-grams, in pieces of bounded size
        low = np.maximum(place[ends[own]] + Q - m, 0)
        high = np.minimum(place[own], len(pattern) - m)
        cut = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
        for lo, hi in zip(low[np.concatenate([[0], cut])].tolist(), high[np.concatenate([cut - 1, [len(own) - 1]])].tolist()):
            for s in range(lo, hi + 1, PIECE):
                part = pattern[s : min(s + PIECE, hi + 1) + m - 1]
                least, end = stretches_in(part, m, text, first + s, width)
                for x, e in zip(end[least <= most].tolist(), least[least <= most].tolist()):
                    yield d, item, max(0, x - m), x, e


FOUND = "doc_id long, item_id long, start long, end long, edits int"


def blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one in the driver at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def searched(docs: DataFrame, benchmark: DataFrame, extra: bool = False) -> list[DataFrame]:
    """Hits of every block of items in ``docs`` (doc_id, text, and row if ``extra``)."""
    out = []
    for items in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(build(items))  # bounded by BLOCK_BYTES

        def run(batches, index=index):
            for batch in batches:
                data, bounds = bytes_of(batch["text"])
                ids = batch["doc_id"].to_pylist()
                for a, b in chunked(bounds, 1 << 20):
                    best: dict[tuple, list] = {}
                    for doc, item, start, end, edits in search(index.value, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]):
                        x = best.setdefault((doc, item), [start, end, edits])
                        x[:] = min(x[0], start), max(x[1], end), min(x[2], edits)
                    rows = [(ids[a + doc], item, *x) for (doc, item), x in sorted(best.items(), key=lambda r: (r[0][0], r[0][1] is not None, r[0][1] or 0))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([
                            pa.array(v, t) for v, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.int32()])
                        ], names=["doc_id", "item_id", "start", "end", "edits"])

        out.append(map_batches(docs, run, FOUND))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: items of ``benchmark`` in texts of ``docs``, from the first to the last place found.

    Letter case of A-Z doesn't count; places are in UTF-8 bytes; ``edits`` is the least of the
    item's stretches. Null texts on either side match nothing, nor do items under ``Q`` bytes;
    null and repeated ids are kept row by row; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = searched(docs, benchmark)
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are; null texts stay."""
    names = docs.columns
    for items in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(build(items))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("searched"))

        def run(batches, index=index):
            for batch in batches:
                data, bounds = bytes_of(batch["searched"])
                keep = np.ones(batch.num_rows, bool)
                for a, b in chunked(bounds, 1 << 20):
                    for doc, *_ in search(index.value, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]):
                        keep[a + doc] = False
                yield batch.select(["row"]).filter(pa.array(keep))

        docs = map_batches(rows, run, rows.select("row").schema).select("row.*")
    return docs


def op9_qgram_leaks(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("edits", F.col("edits").cast("long"))
