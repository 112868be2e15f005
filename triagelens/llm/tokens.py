"""Byte-level BPE ids of whole texts, for use inside Arrow tasks.

The tokenizer splits a text into pre-tokens before it merges bytes, and no merge crosses a
pre-token. A lone space or line feed between two characters that are not white space always
starts a pre-token, so does what follows a lone line feed, and so does a full stop or comma
after an ASCII letter or digit. A text is cut there (``cuts``), each distinct unit is encoded
once by the library, and the ids are put together again.
"""

from __future__ import annotations

import gc
import os
from functools import cache
from itertools import chain

import numpy as np

from triagelens.llm.rolling import Rolling, byte_values, chunked

#: Distinct units kept between batches of a worker; the memory is emptied beyond it.
MEMORY = 1_000_000


def class_of_bytes() -> np.ndarray:
    """1: never white space nor part of it; 2: ASCII letter or digit; 0: may be."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 1
    kind[0x80:] = 1
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = 0  # characters of these first bytes may be white space
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        kind[ord(a) : ord(b) + 1] = 2
    return kind


KIND = class_of_bytes()


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units begin in the UTF-8 bytes of texts in a row."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    begin[bounds] = True
    if n > 2:
        kind = KIND[data]
        # a character's last byte stands for it: those whose first byte may be white space are spoilt up to three bytes on
        last = kind.copy()
        odd = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
        for k in (1, 2):
            last[np.minimum(odd + k, n - 1)] = 0
        inside = ~(begin[1:-2] | begin[2:-1])  # neither at the start of a text nor at its end
        lone = np.isin(data[1:-1], (0x20, 0x0A)) & (last[:-2] > 0) & (kind[2:] > 0) & inside
        begin[1 : n - 1] |= lone
        begin[2:n] |= lone & (data[1:-1] == 0x0A)
        stop = ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & (kind[:-1] == 2)
        begin[1:n] |= stop
    return np.flatnonzero(begin[:n])


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    """Ids of texts by one tokenizer file; units seen before are looked up by a 64-bit hash."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.path, self.memory = path, memory
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, at: np.ndarray, hashes: np.ndarray, units: list[str]) -> None:
        """Keep the ids of new units, given by ascending hash and the place each takes among those known."""
        got = [e.ids for e in tokenizer(self.path).encode_batch_fast(units, add_special_tokens=False)]
        to = at + np.arange(len(at))
        old = np.ones(len(self.hashes) + len(at), bool)
        old[to] = False
        for name, new in (("number", len(self.ends) - 1 + np.arange(len(units))), ("hashes", hashes)):
            merged = np.empty(len(old), new.dtype)
            merged[to] = new
            merged[old] = getattr(self, name)
            setattr(self, name, merged)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted hashes, and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return at, np.zeros(len(hashes), bool)
        return at, self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, given as UTF-8 bytes in a row, and where each text's ids begin and the last ends."""
        if len(self.hashes) > self.memory:
            self.clear()
        starts = cuts(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes, which = np.unique(Rolling(byte_values(0)[data], 0).at(starts, ends - starts), return_inverse=True)
        # any place of a unit will do; asking for the first one takes a slower sort
        first = np.empty(len(hashes), np.int64)
        first[which] = np.arange(len(which))
        at, known = self.find(hashes)
        if not known.all():
            raw = data.tobytes()
            new = first[~known]
            self.learn(at[~known], hashes[~known], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            # each place moves up by the new ones before it
            at = at + np.cumsum(~known) - ~known
        number = self.number[at][which]
        sizes = np.diff(self.ends)[number]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.ends[number] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, bounds)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def encode_chunks(path: str, data: np.ndarray, bounds: np.ndarray, end_id: int, size: int = 2 << 20):
    """Ids with ``end_id`` after each text, a few megabytes at a time: (first text, ids, bounds)."""
    gc.freeze()  # the collector need not walk what stays
    e = encoder(path)
    for a, b in chunked(bounds, size):
        ids, at = e.encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        out = np.full(len(ids) + b - a, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(at))] = ids
        yield a, out, at + np.arange(b - a + 1)
