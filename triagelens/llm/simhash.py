"""SimHash near-duplicates by an inverted index over byte positions.

Two 64-bit fingerprints that differ in d bits agree in 8 - d of their 8 bytes at least. The
index lists the distinct fingerprints by the bytes at several positions at once: of the ``8 - d``
positions that must agree, one half of the fingerprint holds three (d = 3), so eight triples of
positions find every pair. In a list the positional bytes that two fingerprints share are
tallied; those that reach ``8 - d`` are verified by their differing bits. A list gives a spanning
forest of its links, not all its pairs, and equal fingerprints are one entry.

``first_of_each`` takes documents whose five-word shingles have a Jaccard similarity of 0.8 or
more. The index proposes a partner for each text and these pairs are verified on the shingle sets.
No number of differing bits follows from such a similarity, so an exact check follows for what the
fingerprints leave apart (``minhash.similar_sets``); components are formed of verified links alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import keyed, map_batches, read, released, rows_again, spread_width, stage
from triagelens.llm.graph import components
from triagelens.llm.minhash import similar_sets
from triagelens.llm.rolling import bytes_of, chunked, word_spans

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A longer list is first split by one more byte position.
BLOCK = 4096


def fingerprint_array(texts, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of an Arrow string array as uint64."""
    from xxhash import xxh64_intdigest as xxh

    data, bounds = bytes_of(texts)
    out = []
    for a, b in chunked(bounds, 1 << 20):
        own = bounds[a : b + 1] - bounds[a]
        part = data[bounds[a] : bounds[b]]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        starts, ends, upto = word_spans(part, own)
        # the words again, each followed by one space
        sizes = ends - starts + 1
        to = np.concatenate([[0], np.cumsum(sizes)])
        joined = np.full(to[-1], 32, np.uint8)
        src = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
        inside = np.ones(to[-1], bool)
        inside[to[1:] - 1] = False
        joined[inside] = part[src[inside]]
        text = joined.tobytes()
        words = np.diff(upto)
        count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        before = np.concatenate([[0], np.cumsum(count)])
        first = np.repeat(upto[:-1] - before[:-1], count) + np.arange(before[-1])
        last = np.minimum(first + shingle, np.repeat(upto[1:], count))
        h = np.fromiter([xxh(text[x:y], seed) for x, y in zip(to[first].tolist(), (to[last] - 1).tolist())], np.uint64, before[-1])
        fp = np.zeros(b - a, np.uint64)
        full = np.flatnonzero(count)
        if len(full):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, before[full], axis=0, dtype=np.int64)
            fp[full] = np.packbits(2 * ones > count[full, None], axis=1, bitorder="little").view("<u8").ravel()
        out.append(fp)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (key, doc_id, text) to (key, doc_id, fp); a text without words has fingerprint 0."""

    def run(batches):
        for batch in batches:
            fp = pa.array(fingerprint_array(batch["text"]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], fp], names=["key", "doc_id", "fp"])

    return map_batches(docs.select("key", "doc_id", "text"), run, "key long, doc_id long, fp long")


def index_positions(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every choice of 8 - distance positions holds one entirely."""
    half = (8 - distance + 1) // 2
    return [*combinations(range(4), half), *combinations(range(4, 8), half)]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links among distinct fingerprints."""
    out = []
    left = np.arange(len(fps))
    queue: list[int] = []
    while len(left):
        if not queue:
            # start at the most central one: links then lead to an original rather than from copy to copy
            bits = np.unpackbits(fps[left].view(np.uint8).reshape(-1, 8), axis=1)
            centre = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(left)).view(np.uint64)[0]
            k = int(np.argmin(np.bitwise_count(fps[left] ^ centre)))
            queue, left = [int(left[k])], np.delete(left, k)
        while queue and len(left):
            at = queue.pop()
            differ = fps[left] ^ fps[at]
            same = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = same >= 8 - distance
            near[near] = np.bitwise_count(differ[near]) <= distance
            if near.any():
                found = left[near].tolist()
                out += [(at, x) for x in found]
                queue += found
                left = left[~near]
        queue = queue if len(left) else []
    return out


def split_forest(fps: np.ndarray, distance: int, positions: tuple[int, ...]) -> list[tuple[int, int]]:
    """``forest`` of a list whose ``positions`` agree; a long list is split by further positions first.

    Of the other positions all but ``needed - 1`` are enough: each link agrees in one of them.
    """
    needed = 8 - distance - len(positions)
    if len(fps) <= BLOCK or needed < 1:
        return forest(fps, distance)
    out = []
    rest = [p for p in range(8) if p not in positions]
    for p in rest[: len(rest) - needed + 1]:
        byte = fps >> np.uint64(8 * p) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
            out += [(int(part[x]), int(part[y])) for x, y in split_forest(fps[part], distance, (*positions, p))]
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough links among ``fps`` (fp distinct, key) to connect all that differ in ``distance`` bits or fewer."""
    sets = index_positions(distance)
    width = spread_width(fps.sparkSession)

    def posting(number: int, positions: tuple[int, ...]):
        mask = sum(255 << 8 * p for p in positions)
        mask -= (mask >> 63) << 64
        return F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask)))

    posted = fps.select(F.posexplode(F.array(*[posting(k, p) for k, p in enumerate(sets)])).alias("number", "at"), "fp", "key")
    # lists of one are of no use; a count for each list first would cost another shuffle
    dealt = posted.repartition(width, "at").sortWithinPartitions("at", "number", "fp")

    def run(batches):
        kept = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("at", "number", "fp", "key")]
            if kept is not None:
                now = [np.concatenate([x, y]) for x, y in zip(kept, now)]
            new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            cut = new[-1] if len(new) else 0
            kept = [x[cut:] for x in now]
            if cut:
                yield pairs([x[:cut] for x in now], new[:-1])
        if kept is not None and len(kept[0]):
            yield pairs(kept, np.zeros(0, np.int64))

    def pairs(rows, new):
        _, number, fp, key = rows
        fp = fp.view(np.uint64)
        edges = np.concatenate([[0], new, [len(fp)]])
        sizes = np.diff(edges)
        a, b = [], []
        for lo, hi in zip(edges[:-1][sizes > 1].tolist(), edges[1:][sizes > 1].tolist()):
            for x, y in split_forest(fp[lo:hi], distance, sets[number[lo]]):
                a.append(key[lo + x])
                b.append(key[lo + y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long")


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, doc_id, fp, root): root is the least key of the component of ``docs`` (key, doc_id, text)."""
    fps = stage(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("key").alias("rep"))
    linked = components(links(distinct.select("fp", F.col("rep").alias("key")), distance))
    rooted = distinct.join(linked, distinct["rep"] == linked["node"], "left").select("fp", F.coalesce("root", "rep").alias("root"))
    return fps.join(rooted, "fp").select("key", "doc_id", "fp", "root")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs``.

    A null text counts as empty (fingerprint zero); rows with null or equal doc_id stay apart
    and component_id is the doc_id of the first of the component (null sorts first); other
    columns are ignored; an empty table gives no rows.
    """
    found = classes(keyed(docs), distance)
    names = found.where("key = root").select(F.col("root"), F.col("doc_id").alias("component_id"))
    return found.join(names, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_pairs(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: for each text of ``docs`` (key, doc_id, text) a linked one before it, if there is any.

    Equal fingerprints are linked with the first of them, others by the forests of the index.
    """
    fps = stage(fingerprints(docs), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("key").alias("rep"))
    same = fps.join(first, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    near = links(first.select("fp", F.col("rep").alias("key")), distance)
    pairs = same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def first_of_each(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """One row, the first by doc_id, of each class of similar texts; all columns as they are.

    Texts are linked if their distinct ``size``-word shingles have a Jaccard similarity of ``least``
    percent or more. Null texts and texts without words all stay, as nothing is known of them.
    """
    rows = keyed(docs, rows=True)
    kept = released(lambda: similar_sets(rows, size, least, fingerprint_pairs(rows)).where("key = root").select("key"), "kept")
    return rows_again(rows.join(kept, "key", "left_semi"), docs.columns)


def op8_simhash_components(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
