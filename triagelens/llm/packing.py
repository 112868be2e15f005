"""Harmonic packing of token sequences, with free cuts.

Class k holds pieces of at most 1/k of the capacity and puts k of them in each bin. As
documents may be cut, a rest is cut to class sizes exactly: first to whole sequences, then
greedily to the largest capacity // k for k up to 32, below that to powers of two. A bin of
class k is then full but for less than k ids.

Every task fills its own bins and holds back only the unfinished one of each class. Those
pieces are cut to powers of two, whose classes divide the capacity, and bins of the task are
filled again; what is left (less than one bin a class and task) is ranked over all tasks by
sums of counts. The last bins of all are split into power-of-two lengths, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import map_batches, read, stage, tokenizer_path
from triagelens.llm.rolling import bytes_of
from triagelens.llm.tokens import encode_chunks

CAPACITY = 2048
FINEST = 32


def class_sizes(capacity: int = CAPACITY, finest: int = FINEST) -> dict[int, int]:
    """Piece size -> pieces in a bin. The capacity is a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    sizes = {capacity // k: k for k in range(min(finest, capacity), 0, -1)}
    return sizes | {1 << j: capacity >> j for j in range(capacity.bit_length())}


def cut(length: int, sizes: list[int]) -> list[int]:
    """Piece lengths of a document, largest first; ``sizes`` descend to 1."""
    out = []
    for size in sizes:
        if length >= size:
            out += [size] * (length // size)
            length %= size
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, spot int, part int, nth long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
KINDS = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64()]


def pack_tasks(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document; ``bin`` is null for what a task holds back (nth: its number in class and task)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        per_bin = class_sizes(capacity)
        sizes = sorted(per_bin, reverse=True)
        cuts: dict[int, list[int]] = {}
        held: dict[int, list[tuple]] = {size: [] for size in sizes}
        bins, rows = 0, []

        def put(doc, start, raw, total):
            """One piece of class size; a full bin goes out."""
            nonlocal bins
            size = len(raw) // 4
            held[size].append((doc, start, raw, total))
            if len(held[size]) == per_bin[size]:
                number = part << 40 | bins
                rows.extend((d, at, size, zlib.crc32(x), n, number, k * size, part, None) for k, (d, at, x, n) in enumerate(held[size]))
                held[size] = []
                bins += 1

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), KINDS)], names=NAMES)
            rows.clear()
            return batch

        for batch in batches:
            names = batch["doc_id"].to_pylist()
            for at, ids, bounds in encode_chunks(tokenizer, *bytes_of(batch["text"]), end_id):
                raw = ids.astype("<u4").tobytes()
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    start = 0
                    lengths = [capacity] * ((b - a) // capacity)
                    rest = (b - a) % capacity
                    if rest not in cuts:
                        cuts[rest] = cut(rest, sizes)
                    for length in [*lengths, *cuts[rest]]:
                        put(names[at + k], start, raw[4 * (a + start) : 4 * (a + start + length)], b - a)
                        start += length
                if len(rows) > 10_000:
                    yield out()
        for size in sizes:
            if size & (size - 1):
                pieces, held[size] = held[size], []
                for doc, start, raw, total in pieces:
                    for j in reversed(range(size.bit_length())):
                        if size >> j & 1:
                            put(doc, start, raw[: 4 << j], total)
                            start, raw = start + (1 << j), raw[4 << j :]
        for size, pieces in held.items():
            rows.extend((d, at, size, zlib.crc32(x), n, None, None, part, k) for k, (d, at, x, n) in enumerate(pieces))
        if rows:
            yield out()

    return map_batches(docs, run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    A null text is empty (its end id alone); null and repeated doc_ids are kept as they are,
    row by row; other columns are ignored; an empty table gives no rows.
    """
    pieces = stage(pack_tasks(docs, tokenizer, end_id, capacity), "packing")
    whole = pieces.where("bin is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("bin").alias("sequence_id"), F.col("spot").cast("long").alias("offset"))
    rest = pieces.where("bin is null")
    # ranks by sums over one row for each class and task
    counts = rest.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("length").orderBy("part")
    counts = counts.select(
        "length", "part", (F.sum("n").over(ordered) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("all")
    )
    per = F.lit(capacity) / F.col("length")
    ranked = rest.join(counts, ["length", "part"]).withColumn("per", per.cast("long")).withColumn("rank", F.col("before") + F.col("nth"))
    left = F.col("all") % F.col("per")
    inner = F.col("rank") % F.col("per")
    # in the last bin of a class, pieces go to lengths of one power of two each: by the binary digits of their count
    ranked = ranked.withColumn("last", F.col("rank") >= F.col("all") - left).withColumn("left", left).withColumn("inner", inner)
    digits = F.sequence(F.lit(0), F.lit(capacity.bit_length()))
    # the largest sum of leading binary digits of `left` that is not above `inner`
    lead = F.array_max(F.filter(
        F.transform(digits, lambda j: F.call_function("shiftleft", F.call_function("shiftright", F.col("left"), j), j)),
        lambda x: x <= F.col("inner"),
    ))
    group = F.when(F.col("last"), lead).otherwise(F.lit(0))
    bin_no = F.floor(F.col("rank") / F.col("per"))
    # bit 62 marks bins filled over all tasks; class, bin and place in the last bin keep them apart
    log = F.round(F.log2("length")).cast("long")
    number = F.lit(1 << 62) + F.call_function("shiftleft", log, F.lit(56)) + F.call_function("shiftleft", bin_no.cast("long"), F.lit(12)) + group
    shared = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), ((F.col("inner") - group) * F.col("length")).alias("offset")
    )
    return whole.unionByName(shared)


def op3_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), 1)
