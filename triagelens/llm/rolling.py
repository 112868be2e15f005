"""Hashes of all windows of many sequences at once, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd bases of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on a fresh array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


@cache
def byte_values(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[which]))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** j and base ** -j modulo 2 ** 64 for j up to n."""
    got = _powers.get(which)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, 1 << 20)
        base = BASES[which]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        got = _powers[which] = (pair[0], pair[1])
    return got


class Rolling:
    """Polynomial hashes of any slices of one array of unit values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.which = which
        up, self.down = powers(which, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Hashes of all slices of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array in a row, and the bounds of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None and raw.buffers()[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes other than ASCII white space), and the words before each text's end."""
    blank = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = ~blank
    begin[1:] &= blank[:-1] | edge[1:-1]
    end = ~blank
    end[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def distinct_grams(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct run of ``size`` words (fewer words: all), A-Z lowered, by text and hash."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, upto = word_spans(low, bounds)
    roll = Rolling(Rolling(byte_values(0)[low], 0).at(starts, ends - starts), 1)
    words = np.diff(upto)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), count)
    first = np.arange(count.sum()) + np.repeat(upto[:-1] - (np.cumsum(count) - count), count)
    grams = roll.at(first, np.minimum(size, words)[doc])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[fresh], grams[fresh]


def window_min(keys: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by doubling."""
    if len(keys) < size:
        return keys[:0]
    got = 1
    while got * 2 <= size:
        keys = np.minimum(keys[:-got], keys[got:])
        got *= 2
    return np.minimum(keys[: len(keys) - (size - got)], keys[size - got :]) if size > got else keys


def chunked(bounds: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes together; a longer text is alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to
