"""Periodic runs of words by Kruskal's rule over descending LCPs.

The suffixes of a text, one for each word, are ordered by prefix doubling; neighbours in that
order with the length of their longest common prefix (LCP) are the edges of a tree. Taken by
decreasing LCP, an edge unites two classes of suffixes, each an ordered set of positions under
union-find, the smaller one into the larger. Two positions that are next to each other in the
united set, but come from different sides, have exactly that LCP: at a distance p within it they
seed a run of period p. A run's leftmost pair (start, start + p) is always such a pair if p is
the smallest period and the run holds two periods or more: another position between them would
give a smaller period. So each run is found once, where the words before the two differ.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import map_batches, read
from triagelens.llm.rolling import Rolling, byte_values, bytes_of, chunked, mix, word_spans

LENGTH, EXPONENT = 6, 4
#: Bytes of texts worked on at once; a longer text is alone and takes about 150 bytes of memory for each word.
CHUNK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_ranks(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... units, until no two are equal.

    ``values`` never agree across texts; ``ends`` tells where the text of each unit ends. A rank is
    the place of the first of its group; only suffixes still in groups are sorted again.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = values[order][1:] != values[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, size = [rank], 1
    left = order[~(fresh & np.append(fresh[1:], True))]
    while len(left):
        after = left + size
        second = np.where(after < ends[left], rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[left] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        left, pair = left[order], pair[order]
        fresh = np.ones(len(left), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        old = rank[left]
        outer = np.ones(len(left), bool)
        outer[1:] = old[1:] != old[:-1]
        at = np.arange(len(left))
        rank = rank.copy()
        rank[left] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        levels.append(rank)
        size *= 2
        left = left[~(fresh & np.append(fresh[1:], True))]
    return levels


def common_prefixes(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact LCP of the suffixes ``a`` with ``b``, by halving steps over the ranks."""
    n = len(ends)
    lcp = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        x, y = a + lcp, b + lcp
        inside = (x < ends[a]) & (y < ends[b])
        same = levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        lcp += (inside & same).astype(np.int64) << k
    return lcp


def seeds(a: list[int], b: list[int], lcp: list[int], exponent: int) -> list[tuple[int, int, int]]:
    """(i, j, LCP) of positions that become neighbours in a class, near enough for ``exponent`` periods.

    ``a``, ``b`` are edges between suffixes by descending ``lcp``.
    """
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x] = x
            members[x] = [x]
            return x
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y, common in zip(a, b, lcp):
        x, y = root(x), root(y)
        if len(members[x]) < len(members[y]):
            x, y = y, x
        parent[y] = x
        large, small = members[x], members.pop(y)
        reach = common // (exponent - 1)
        places = [bisect_left(large, i) for i in small]
        for k, i in enumerate(small):
            at = places[k]
            if at and (k == 0 or places[k - 1] != at) and i - large[at - 1] <= reach:
                found.append((large[at - 1], i, common))
            if at < len(large) and (k + 1 == len(small) or places[k + 1] != at) and large[at] - i <= reach:
                found.append((i, large[at], common))
        if len(small) * 16 > len(large):
            large += small
            large.sort()
        else:
            for i in small:
                insort(large, i)
    return found


def find_runs(values: np.ndarray, upto: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of several texts.

    ``values`` are unit values that never agree across texts, ``upto`` the units before each
    text's end, starting with 0. A run is as long as max(length, exponent * period) at least; the
    exponent is 2 or more. Starts count over all texts.
    """
    if exponent < 2:
        raise ValueError("runs of less than two periods are not unique")
    none = np.zeros((0, 3), np.int64)
    if len(values) < length:
        return none
    ends = np.repeat(upto[1:], np.diff(upto))
    levels = suffix_ranks(values, ends)
    # the shortest LCP that a run's leftmost pair may have
    least = min(max(length, exponent * p) - p for p in (max(1, length // exponent), length // exponent + 1))
    order = np.empty(len(values), np.int64)
    order[levels[-1]] = np.arange(len(values))
    known = min(least.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[known][order[1:]] == levels[known][order[:-1]])
    a, b = order[near], order[near + 1]
    lcp = common_prefixes(levels, ends, a, b)
    keep = lcp >= least
    a, b, lcp = a[keep], b[keep], lcp[keep]
    down = np.argsort(-lcp, kind="stable")
    got = seeds(a[down].tolist(), b[down].tolist(), lcp[down].tolist(), exponent)
    if not got:
        return none
    i, j, common = np.array(got, np.int64).T
    first = np.isin(i, upto) | (values[i - 1] != values[j - 1])
    whole = first & (j - i + common >= length)
    i, j, common = i[whole], j[whole], common[whole]
    rows = np.stack([i, j - i + common, j - i], axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> list[str]:
    """The words of each text joined by one space."""
    sizes = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(to[-1], 32, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    out[inside] = data[(np.repeat(starts - to[:-1], sizes) + np.arange(to[-1]))[inside]]
    text = out.tobytes()
    return [text[x : max(x, y - 1)].decode() for x, y in zip(to[upto[:-1]].tolist(), to[upto[1:]].tolist())]


def word_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period in words) and collapsed text of each row of ``docs``.

    A run has its smallest period, is ``length`` words and ``exponent`` periods long at least and
    can't be extended; runs come by start, then period. ``collapsed`` has the words that no run
    contains after its first period, joined by one space. A null text and one without words have
    no run and collapse to an empty text; rows with null or equal doc_id are rows of their own;
    other columns are ignored; an empty table gives no rows. Each text is worked on alone, so
    nothing is shuffled and a hot source or copies cost no more than other rows. Words are
    compared by 64-bit hashes within a text.
    """

    def run(batches):
        for batch in batches:
            data, bounds = bytes_of(batch["text"])
            for a, b in chunked(bounds, CHUNK):
                part = data[bounds[a] : bounds[b]]
                starts, ends, upto = word_spans(part, bounds[a : b + 1] - bounds[a])
                doc = np.repeat(np.arange(b - a), np.diff(upto)).astype(np.uint64)
                hashes = Rolling(byte_values(0)[part], 0).at(starts, ends - starts)
                runs = find_runs(mix(hashes + mix(doc)), upto, length, exponent)
                kept = ~dropped(runs, len(starts))
                left = np.concatenate([[0], np.cumsum(kept)])[upto]
                texts = joined(part, starts[kept], ends[kept], left)
                cut = np.searchsorted(runs[:, 0], upto)
                begin = runs[:, 0] - upto[np.repeat(np.arange(b - a), np.diff(cut))]
                struct = pa.StructArray.from_arrays([pa.array(begin), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][a:b], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), struct), pa.array(texts, pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def most_periodic(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where one text in ten, by the crc32 of doc_id, repeats its words from some word on.

    A text without doc_id or words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def edited(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        index = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))
        return F.array_join(F.transform(index, lambda i: F.get(w, i)), " ")

    chosen = docs.withColumn("words", F.when(h % 10 == 0, words))
    return chosen.select("doc_id", F.when(F.size("words") > 0, edited(F.col("words"))).otherwise(F.col("text")).alias("text"))


def op12_descending_lcp_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents`` after the edit of ``with_repeated_tails``; see ``word_runs`` for
    nulls, empty texts, repeated rows, clashing columns and empty tables."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = word_runs(with_repeated_tails(docs)).withColumn("best", most_periodic(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
