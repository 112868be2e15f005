"""Re-Pair compressed token-id shards with random access.

Documents are cut into ranges of ascending doc_id, each range is encoded in order and closed
into shards of about a million ids. Per shard, frequent pairs of neighbouring symbols are
replaced by nonterminals again and again; no pair reaches over a document's end. A shard is
one row of a Parquet table in the shared folder (so any store works and Spark's commit
protocol covers lost tasks); its payload is the file format:

    b"RPG1", then little-endian: u32 first nonterminal, u32 rules, u32 documents,
    u32 bytes a symbol, u64 symbols; rules as u32 pairs; u32 expansion length of each rule;
    u64 symbol bounds of the documents (one more than documents); the symbols.

A rule's parts are ids or earlier rules. Expansion lengths let a reader skip to any id of any
document without expanding what lies before it (``token_at``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import buckets_by_id, by_bucket, map_batches, read, spread_width, stage, tokenizer_path
from triagelens.llm.rolling import bytes_of
from triagelens.llm.tokens import encode_chunks

SHARD_IDS = 1 << 20
ROUNDS = 4
LEAST = 12
HEAD = struct.Struct("<4sIIIIQ")


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, the number of each place's value and the counts, as ``np.unique`` gives them.

    Value and place are sorted as one number where they fit, several times as fast as sorting places by value.
    """
    right, place = int((code & 0xFFFFFF).max(initial=0)).bit_length(), len(code).bit_length()
    if not len(code) or int((code >> 24).max()).bit_length() + right + place > 63:
        return np.unique(code, return_inverse=True, return_counts=True)
    both = ((code >> 24 << right | code & 0xFFFFFF) << place) | np.arange(len(code))
    both.sort()
    value, at = both >> place, both & (1 << place) - 1
    first = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1])
    count = np.diff(np.append(first, len(value)))
    which = np.empty(len(code), np.int64)
    which[at] = np.repeat(np.arange(len(first)), count)
    value = value[first]
    return value >> right << 24 | value & (1 << right) - 1, which, count


def compress(ids: np.ndarray, bounds: np.ndarray, base: int, rounds: int = ROUNDS, least: int = LEAST):
    """Symbols, symbol bounds of the documents and rules (pairs) of one shard.

    Each round replaces every pair that is seen ``least`` times or more, most frequent first
    while 16-bit symbols last; where chosen pairs overlap, the left one wins.
    """
    s = ids.astype(np.int64)
    last = np.zeros(len(s), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    rules = np.zeros((0, 2), np.int64)
    room = max(0, (1 << 16) - base) if base < 1 << 16 else 1 << 16
    for turn in range(rounds):
        if len(s) < 2 * least:
            break
        code = (s[:-1] << 24) | s[1:]
        # a table of hashed counts tells most rare pairs without sorting them
        slot = ((code * -7046029254386353131) >> 44) & 0xFFFFF
        slot[last[:-1]] = 0x100000
        often = np.bincount(slot, minlength=0x100001) >= least
        often[0x100000] = False
        at = np.flatnonzero(often[slot])
        pairs, which, count = distinct(code[at])
        order = np.argsort(-count, kind="stable")[: room // (rounds - turn) if turn < rounds - 1 else room]
        order = order[count[order] >= least]
        if not len(order):
            break
        number = np.full(len(pairs), -1)
        number[order] = np.arange(len(order))
        at, number = at[number[which] >= 0], number[which][number[which] >= 0]
        start = np.ones(len(at), bool)
        start[1:] = np.diff(at) > 1
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at, number = at[run % 2 == 0], number[run % 2 == 0]
        used = np.bincount(number, minlength=len(order)) >= least // 2
        fresh = np.cumsum(used) - 1
        at, number = at[used[number]], fresh[number[used[number]]]
        rules_now = pairs[order][used]
        s[at] = base + len(rules) + number
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        rules = np.concatenate([rules, np.stack([rules_now >> 24, rules_now & 0xFFFFFF], 1)])
        room -= len(rules_now)
        before = np.concatenate([[0], np.cumsum(keep)])
        bounds, s, last = before[bounds], s[keep], last[keep]
    return s, bounds, rules


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    done: list[int] = []
    for a, b in rules.tolist():
        done.append((done[a - base] if a >= base else 1) + (done[b - base] if b >= base else 1))
    return np.array(done, np.int64)


def pack(ids: np.ndarray, bounds: np.ndarray, base: int, rounds: int = ROUNDS, least: int = LEAST) -> bytes:
    symbols, at, rules = compress(ids, bounds, base, rounds, least)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(b"RPG1", base, len(rules), len(bounds) - 1, width, len(symbols))
    parts = [rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), at.astype("<u8"), symbols.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        magic, self.base, n_rules, n_docs, width, n = HEAD.unpack_from(payload)
        if magic != b"RPG1":
            raise ValueError("not a Re-Pair shard")
        at = HEAD.size
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        self.sizes = np.frombuffer(payload, "<u4", n_rules, at := at + 8 * n_rules).astype(np.int64)
        self.bounds = np.frombuffer(payload, "<u8", n_docs + 1, at := at + 4 * n_rules).astype(np.int64)
        self.symbols = np.frombuffer(payload, f"<u{width}", n, at + 8 * (n_docs + 1)).astype(np.int64)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        deep = symbols >= self.base
        out[deep] = self.sizes[symbols[deep] - self.base]
        return out

    def expand_all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the documents' bounds in them."""
        start = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.sizes) - self.sizes])
        flat = np.empty(self.base + int(self.sizes.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        begin, size = start.tolist(), [*[1] * self.base, *self.sizes.tolist()]
        for k, (a, b) in enumerate(self.rules.tolist()):
            to, la, lb = begin[self.base + k], size[a], size[b]
            flat[to : to + la] = flat[begin[a] : begin[a] + la]
            flat[to + la : to + la + lb] = flat[begin[b] : begin[b] + lb]
        sizes = self.lengths(self.symbols)
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(start[self.symbols] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[self.bounds]

    def token_at(self, doc: int, index: int) -> int:
        """The id at ``index`` of the shard's document ``doc``, by expansion lengths alone."""
        symbols = self.symbols[self.bounds[doc] : self.bounds[doc + 1]]
        ends = np.cumsum(self.lengths(symbols))
        if not 0 <= index < (ends[-1] if len(ends) else 0):
            raise IndexError(index)
        k = int(np.searchsorted(ends, index, "right"))
        index -= int(ends[k - 1]) if k else 0
        symbol = int(symbols[k])
        while symbol >= self.base:
            a, b = self.rules[symbol - self.base].tolist()
            left = int(self.sizes[a - self.base]) if a >= self.base else 1
            symbol, index = (a, index) if index < left else (b, index - left)
        return symbol


SHARDS = "bucket int, first long, n_ids long, doc_ids array<long>, payload binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS, name: str = "repair") -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shard table; returns it as read back.

    Null texts are empty (their end id alone); null doc_ids come first; rows with equal
    doc_id are ordered by text; other columns are ignored. An empty table gives no shards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, n = buckets_by_id(docs, spread_width(spark))
    base = len_vocabulary(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []
        first, at_bucket, size = 0, 0, 0

        def close():
            nonlocal first, size
            ids, bounds = np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)])
            row = [[at_bucket], [first], [len(ids)], [list(names)], [pack(ids, bounds, base)]]
            first, size = first + len(ids), 0
            for kept in (held, sizes, names):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, TYPES)], names=NAMES)

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            buckets = batch["bucket"].to_pylist()
            for at, ids, bounds in encode_chunks(tokenizer, *bytes_of(batch["text"]), end_id):
                for k in range(len(bounds) - 1):
                    if buckets[at + k] != at_bucket:
                        if names:
                            yield close()
                        first, at_bucket = 0, buckets[at + k]
                    held.append(ids[bounds[k] : bounds[k + 1]])
                    sizes.append(len(held[-1]))
                    names.append(doc_ids[at + k])
                    size += sizes[-1]
                    if size >= shard_ids:
                        yield close()
        if names:
            yield close()

    ordered = by_bucket(docs.withColumn("bucket", bucket), n).sortWithinPartitions("bucket", "doc_id", "text")
    return stage(map_batches(ordered, encode, SHARDS), name)


NAMES = ["bucket", "first", "n_ids", "doc_ids", "payload"]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def len_vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode every shard: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, bounds = Shard(batch["payload"][row].as_py()).expand_all()
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch["bucket"][row].as_py()), pa.int32()), pa.array(batch["doc_ids"][row].as_py(), pa.int64()),
                    pa.array(bounds[:-1] + batch["first"][row].as_py()), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()),
                ], names=["bucket", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = map_batches(shards.select("bucket", "first", "doc_ids", "payload"), decode, "bucket int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # one row a range: as many as shuffle partitions
    totals = shards.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = totals.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    joined = rows.join(F.broadcast(before), "bucket")
    return joined.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_shards(spark, sf_dir: str) -> DataFrame:
    shards = write_shards(read(spark, sf_dir, "documents"), tokenizer_path(), 0)
    return read_documents(shards)
