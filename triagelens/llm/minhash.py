"""MinHash near-duplicates by tensored banding.

A table key would be four minhashes of a set. In place of ``TABLES ** 2`` independent keys, two
collections of ``TABLES`` short groups of minhashes are made, and each pair of a group from the
first and one from the second is a key: ``4 * TABLES`` minhashes serve ``TABLES ** 2`` tables. The
first collection deals the rows out over the cluster, the second splits every list in its task.

Two sets of Jaccard similarity s share a key with probability ``(1 - (1 - s ** 2) ** TABLES) ** 2``;
at s = 0.8 a pair is missed with 1.2e-6, at 0.85 with 3e-8. Of the pairs that share a key, those
stay that agree in ``AGREE`` of all 56 minhashes (a pair of 0.8 fails with 1.2e-7) and whose sizes
allow the similarity. What is left is verified on the full shingle sets.

Equal sets are one entry. A list first gives a spanning forest of its candidates; of these a text's
best one is verified, then the best between any two components. After that all candidates that
verified links have not joined are tested where they meet, so only links leave a task. Long lists
are split into blocks, and later into pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import keyed, map_batches, read, released, spread_width, stage
from triagelens.llm.graph import components
from triagelens.llm.rolling import bytes_of, chunked, distinct_grams, mix

SHINGLE, LEAST = 4, 80
#: Groups in each of the two collections, minhashes in a group, and minhashes that must agree of all.
TABLES, GROUP, AGREE = 14, 2, 28
HASHES = 2 * TABLES * GROUP
#: Members of a list that meet in one task, and pairs of one text that are verified in one.
LONG, STAR = 4096, 256
#: Shingles of the sets of one side that meet in one task.
SETS = 1 << 20
CHUNK = 1 << 20
SKETCH = "key long, doc_id long, n int, w1 long, w2 long, keys array<long>, sig binary"
MEMBERS = ["at", "key", "n", "sig"]


def minhashes(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minhashes (one row a set) of non-empty sets of mixed 64-bit hashes that start at ``begin``."""
    out = np.empty((HASHES, len(begin)), np.uint64)
    salts = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).reshape(2, HASHES)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((grams ^ salts[0, k]) * (salts[1, k] | np.uint64(1)), begin)
    return mix(out).T


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(key, doc_id, n, w1, w2, keys, sig) of ``docs`` (key, doc_id, text): number of shingles, two hashes of
    the set, the groups of the first collection, and a byte of each minhash. A text without words has n = 0."""

    def run(batches):
        for batch in batches:
            data, bounds = bytes_of(batch["text"])
            for a, b in chunked(bounds, CHUNK):
                own = bounds[a : b + 1] - bounds[a]
                doc, grams = distinct_grams(data[bounds[a] : bounds[b]], own, size)
                n = np.bincount(doc, minlength=b - a)
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                w = np.zeros((2, b - a), np.uint64)
                keys = np.zeros((len(full), TABLES), np.uint64)
                sig = np.zeros((len(full), HASHES), np.uint8)
                if len(full):
                    w[0, full] = np.add.reduceat(mix(grams), begin)
                    w[1, full] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5)), begin)
                    least = minhashes(grams, begin)
                    sig = least.astype(np.uint8)
                    first = least[:, : TABLES * GROUP].reshape(-1, TABLES, GROUP)
                    keys = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), keys.shape).copy()
                    for k in range(GROUP):
                        keys = mix(keys + first[:, :, k])
                yield pa.RecordBatch.from_arrays([
                    batch["key"][a:b], batch["doc_id"][a:b], pa.array(n.astype(np.int32)), pa.array(w[0].view(np.int64)), pa.array(w[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(spans(n > 0, TABLES)), pa.array(keys.ravel().view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(spans(n > 0, HASHES)), pa.py_buffer(np.ascontiguousarray(sig))]),
                ], names=["key", "doc_id", "n", "w1", "w2", "keys", "sig"])

    return map_batches(docs.select("key", "doc_id", "text"), run, SKETCH)


def spans(full: np.ndarray, width: int) -> np.ndarray:
    """Offsets of rows that hold ``width`` values each, or none."""
    return np.concatenate([[0], np.cumsum(full) * width]).astype(np.int32)


def matrix(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, HASHES)


def groups(keys: pa.Array) -> np.ndarray:
    return keys.flatten().to_numpy().reshape(-1, TABLES)


def alike(sig: np.ndarray, n: np.ndarray, x, y, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows ``x`` and ``y`` share a group of the second collection and may reach ``least``, and their agreements."""
    same = sig[x] == sig[y]
    agree = same.sum(-1)
    second = same[..., TABLES * GROUP :].reshape(*same.shape[:-1], TABLES, GROUP).all(-1).any(-1)
    small, great = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    return second & (agree >= AGREE) & (100 * small >= least * great), agree


def forest(key: np.ndarray, n: np.ndarray, sig: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Spanning forest (a, b, agreements), as places, of the candidates in one list; it starts at the same texts in all lists."""
    out: list[tuple[int, int, int]] = []
    left = np.argsort(mix(key.view(np.uint64)), kind="stable")
    queue: list[int] = []
    while len(left) and len(left) + len(queue) > 1:
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop(0)
        near, agree = alike(sig, n, left, at, least)
        if near.any():
            found = left[near].tolist()
            out += zip([at] * len(found), found, agree[near].tolist())
            queue += found
            left = left[~near]
    return out


def pairs_batch(a, b, agree) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.asarray(agree, np.int32))], names=["a", "b", "agree"])


def blocks(posted: DataFrame, many: DataFrame) -> DataFrame:
    """``posted`` (at, key ...) where each list in ``many`` (at, count) is dealt out to several, by its members' keys."""
    part = F.pmod(F.xxhash64("key", "at"), F.ceil(F.col("count") / LONG))
    return posted.join(many, "at", "left").withColumn("at", F.when(F.col("count").isNotNull(), F.xxhash64("at", part)).otherwise(F.col("at"))).drop("count")


def long_lists(sets: DataFrame) -> DataFrame:
    """(at, count) of the lists of ``sets`` (keys) with more than ``LONG`` members."""
    return stage(sets.select(F.explode("keys").alias("at")).groupBy("at").count().where(F.col("count") > LONG), "long-lists")


def candidates(sets: DataFrame, many: DataFrame, least: int) -> DataFrame:
    """(a, b, agree): spanning forests of the candidates in each list, or block of a list, of ``sets`` (key, n, keys, sig)."""

    def run(batches):
        for (_, key, n, sig), sizes in lists(batches, MEMBERS):
            n = n.astype(np.int64)
            first = np.cumsum(sizes) - sizes
            x = first[sizes == 2]
            near, agree = alike(sig, n, x, x + 1, least)
            a, b, count = [key[x[near]]], [key[x[near] + 1]], [agree[near]]
            for lo, size in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found = forest(key[lo : lo + size], n[lo : lo + size], sig[lo : lo + size], least)
                if found:
                    i, j, k = np.array(found).T
                    a.append(key[lo + i])
                    b.append(key[lo + j])
                    count.append(k)
            yield pairs_batch(*(np.concatenate(c) for c in (a, b, count)))

    dealt = blocks(sets.select(F.explode("keys").alias("at"), "key", "n", "sig"), many).repartition(spread_width(sets.sparkSession), "at")
    found = map_batches(dealt.sortWithinPartitions("at").select(MEMBERS), run, "a long, b long, agree int")
    return stage(found.distinct(), "candidates")


def lists(batches, names: list[str]):
    """Columns of whole lists, of rows in the order of ``at``, the first of ``names``, and the size of each list."""
    kept = None
    for batch in batches:
        now = [matrix(batch[c]) if c == "sig" else groups(batch[c]) if c == "keys" else batch[c].to_numpy(zero_copy_only=False) for c in names]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now)]
        new = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        cut = new[-1] if len(new) else 0
        kept = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now], np.diff(np.concatenate([[0], new]))
    if kept is not None and len(kept[0]):
        yield kept, np.array([len(kept[0])])


def shingle_sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(key, grams) for those of ``docs`` (key, text) in ``keys``: the set's hashes, ascending, as bytes."""

    def run(batches):
        for batch in batches:
            data, bounds = bytes_of(batch["text"])
            for a, b in chunked(bounds, CHUNK):
                doc, grams = distinct_grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                at = np.searchsorted(doc, np.arange(b - a + 1)) * 8
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(grams)])
                yield pa.RecordBatch.from_arrays([batch["key"][a:b], raw], names=["key", "grams"])

    wanted = docs.select("key", "text").join(keys.select("key").hint("merge"), "key", "left_semi")
    return map_batches(wanted, run, "key long, grams binary")


def unjoined(docs: DataFrame, sets: DataFrame, found: DataFrame, many: DataFrame, rooted: DataFrame, size: int, least: int) -> DataFrame:
    """(a, b): links, verified on full sets, between all candidates that ``rooted`` (node, root) has in different components.

    In each list the rows outside of its largest component meet all others. Full sets travel
    with the rows of such lists, so only links leave a task: one for each row and component, as
    that joins them. A list whose sets are more than ``SETS`` shingles together is dealt out to
    several tasks, each with a part of either side. A pair is tested in the first list it shares.
    A text without any candidate in ``found`` has none in its lists, but for those ``many`` names,
    where only blocks were looked at.
    """
    paired = found.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("paired", F.lit(True))
    known = sets.join(rooted.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).join(paired, "key", "left")
    posted = known.select(F.posexplode("keys").alias("number", "at"), "key", "root", "n", "paired").join(many, "at", "left")
    posted = posted.where(F.col("paired") | F.col("count").isNotNull()).drop("paired", "count")
    shares = posted.groupBy("at", "root").agg(F.sum("n").alias("grams"))
    open_ = shares.groupBy("at").agg(F.max_by("root", F.struct("grams", "root")).alias("main"), F.sum("grams").alias("grams"), F.count(F.lit(1)).alias("roots"))
    open_ = stage(open_.where("roots > 1").select("at", "main", F.ceil(F.col("grams") / SETS).cast("int").alias("parts")), "open-lists")
    sent = stage(posted.join(open_, "at"), "open-rows")
    full = stage(shingle_sets(docs, sent.select("key").distinct(), size), "open-sets")
    own = F.pmod(F.xxhash64("key", "at"), F.col("parts").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # a row is host in its part of the hosts for each part of the guests, and a guest the other way round
    host = F.transform(every, lambda q: F.struct(F.col("own").alias("p"), q.alias("q")))
    guest = F.when(F.col("root") != F.col("main"), F.transform(every, lambda p: F.struct(p.alias("p"), F.col("own").alias("q"))))
    cells = F.array_distinct(F.concat(host, F.coalesce(guest, F.array().cast("array<struct<p:int,q:int>>"))))
    dealt = sent.withColumn("own", own).withColumn("cell", F.explode(cells))
    dealt = dealt.select(
        F.xxhash64("at", "cell").alias("at"), "number", "key", "root", "n", (F.col("cell.p") == F.col("own")).alias("host"),
        ((F.col("cell.q") == F.col("own")) & (F.col("root") != F.col("main"))).alias("guest"))
    names = ["at", "number", "key", "root", "n", "host", "guest", "keys", "sig", "grams"]
    whole = full.join(sets.select("key", "keys", "sig"), "key")
    dealt = dealt.join(whole, "key").repartition(spread_width(docs.sparkSession), "at")

    def run(batches):
        for columns, sizes in lists(batches, names):
            a, b, agree = [], [], []
            edges = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in zip(edges[:-1][sizes > 1].tolist(), edges[1:][sizes > 1].tolist()):
                for x, y in links_across(*(c[lo:hi] for c in columns[1:]), least):
                    a.append(x)
                    b.append(y)
                    agree.append(0)
            yield pairs_batch(a, b, agree)

    found = map_batches(dealt.sortWithinPartitions("at").select(names), run, "a long, b long, agree int")
    return stage(found.select("a", "b").distinct(), "unjoined")


def links_across(number, key, root, n, host, guest, keys, sig, grams, least: int):
    """(a, b) keys of links between the guests and the hosts of one list; each guest is linked to a component once."""
    n = n.astype(np.int64)
    hosts = np.flatnonzero(host)
    first = int(number[0])
    for g in np.flatnonzero(guest).tolist():
        left = hosts[root[hosts] != root[g]]
        near, agree = alike(sig, n, left, g, least)
        near &= ~(keys[left, :first] == keys[g, :first]).any(1)
        left = left[near][np.argsort(-agree[near], kind="stable")]
        own = np.frombuffer(grams[g], np.uint64)
        step = 16
        while len(left):
            some, left = left[:step], left[step:]
            whole = np.frombuffer(b"".join(grams[some]), np.uint64)
            place = np.minimum(np.searchsorted(own, whole), len(own) - 1)
            both = np.add.reduceat(own[place] == whole, np.cumsum(n[some]) - n[some], dtype=np.int64)
            linked = some[100 * both >= least * (n[some] + n[g] - both)]
            if len(linked):
                for r in np.unique(root[linked]).tolist():
                    yield key[g], key[linked[root[linked] == r][0]]
                left = left[~np.isin(root[left], root[linked])]
            step = 1024


def verified(docs: DataFrame, pairs: DataFrame, size: int, least: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts in ``docs`` (key, text) have a similarity of ``least`` percent or more.

    A text is sent once for each of its partners b, and once for each block of ``STAR`` pairs to which it is the centre a.
    """
    pairs = stage(pairs.select("a", "b"), "pairs")
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    dealt = pairs.join(degree, "a").withColumn("block", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))))
    ends = dealt.select("block", F.col("b").alias("key"), F.col("a").alias("partner"))
    centres = dealt.select("block", F.col("a").alias("key"), F.lit(None).cast("long").alias("partner")).distinct()
    ends = stage(ends.unionByName(centres), "ends")

    def run(batches):
        centre = whose = None
        for batch in batches:
            data, bounds = bytes_of(batch["text"])
            keys, partners = batch["key"].to_pylist(), batch["partner"].to_pylist()
            a_out, b_out = [], []
            for a, b in chunked(bounds, CHUNK):
                doc, grams = distinct_grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                for k in range(a, b):
                    own = grams[at[k - a] : at[k - a + 1]]
                    if partners[k] is None:
                        centre, whose = own.copy(), keys[k]
                    else:
                        assert partners[k] == whose
                        place = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                        both = int((centre[place] == own).sum())
                        if 100 * both >= least * (len(own) + len(centre) - both):
                            a_out.append(whose)
                            b_out.append(keys[k])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    # said to be a merge at every size, as the ends grow with the texts
    texts = docs.select("key", "text").join(ends.hint("merge"), "key").repartition(spread_width(docs.sparkSession), "block")
    # two centres whose blocks share a hash stay apart by the centre's key
    order = [F.col("block"), F.coalesce("partner", "key"), F.col("partner").asc_nulls_first()]
    return stage(map_batches(texts.sortWithinPartitions(*order).select("key", "partner", "text"), run, "a long, b long"), "linked")


def similar_sets(docs: DataFrame, size: int = SHINGLE, least: int = LEAST, proposed: DataFrame | None = None) -> DataFrame:
    """(key, doc_id, n, root) for ``docs`` (key, doc_id, text); root is the least key of the component.

    Pairs ``proposed`` (a, b) by another method are verified first; what they join is not tested again.
    """
    seen = stage(sketches(docs, size), "sketches")
    whole = ["n", "w1", "w2"]
    sets = seen.where("n > 0").groupBy(*whole).agg(F.min("key").alias("key"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    sets = stage(sets, "sets")
    many = long_lists(sets)
    found = candidates(sets, many, least)
    # one link for each text to begin with, to the partner that agrees most; most of the others are joined by then
    if proposed is None:
        linked, open_ = None, found
    else:
        linked = verified(docs, between_sets(proposed, seen, sets, whole), size, least)
        open_ = apart(found, components(linked))
    best = open_.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    fresh = verified(docs, best, size, least)
    linked = fresh if linked is None else linked.unionByName(fresh)
    rooted = components(linked)
    linked = linked.unionByName(verified(docs, across(found, rooted), size, least))
    rooted = components(linked)
    more = unjoined(docs, sets, found, many, rooted, size, least)
    if not more.isEmpty():
        rooted = components(linked.unionByName(more))
    roots = sets.join(rooted, F.col("key") == F.col("node"), "left").select(*whole, F.coalesce("root", "key").alias("root"))
    return seen.join(roots, whole, "left").select("key", "doc_id", "n", F.coalesce("root", "key").alias("root"))


def between_sets(pairs: DataFrame, seen: DataFrame, sets: DataFrame, whole: list[str]) -> DataFrame:
    """``pairs`` (a, b) of texts as pairs of the entries in ``sets`` that stand for them."""
    stands = seen.select(F.col("key").alias("node"), *whole).join(sets.select(*whole, "key"), whole).select("node", "key")
    for end in ("a", "b"):
        pairs = pairs.join(stands.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("key", end)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, agree) whose ends are in different components ra and rb of ``rooted`` (node, root)."""
    for end in ("a", "b"):
        pairs = pairs.join(rooted.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    return pairs.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")


def across(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b, agree) between any two components of ``rooted`` (node, root) the one that agrees most."""
    best = apart(pairs, rooted).groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
    return best.agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``.

    Texts are linked if their distinct ``size``-word shingles (A-Z lowered; fewer words: all as
    one) have a Jaccard similarity of ``least`` percent or more; component_id is the smallest
    doc_id that links reach, kept tells whether it is the row's own. A null text, and one without
    words, has no shingle and is linked with nothing; rows with null or equal doc_id are rows of
    their own, ordered by text, of which one of each component is kept; other columns are
    ignored; an empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    rows = keyed(docs)
    found = released(lambda: similar_sets(rows, size, least), "components")
    names = found.where("key = root").select("root", F.col("doc_id").alias("component_id"))
    joined = found.join(names, "root")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("key") == F.col("root")).alias("kept"))


def op13_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over every whole text of ``documents``; see ``near_duplicates`` for nulls,
    empty texts, repeated rows, clashing columns and empty tables."""
    return near_duplicates(read(spark, sf_dir, "documents"))
