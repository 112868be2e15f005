"""Periodic runs, hard negatives and tensored MinHash against plain versions, on the awkward rows of the shared corpus and on families of their own."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import corpus, frame, unique, words
from triagelens.llm import minhash, negatives, runs
from triagelens.llm.common import keyed
from triagelens.llm.queries import ORACLES, QUERIES
from triagelens.llm.rolling import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- periodic runs -------------------------------------------------------------


def plain_runs(w, length=6, exponent=4):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            part = w[i : i + size]
            smaller = any(all(part[k] == part[k + q] for k in range(size - q)) for q in range(1, p))
            if j > i and size >= max(length, exponent * p) and not smaller:
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, found):
    gone = set()
    for s, size, p in found:
        gone.update(range(s + p, s + size))
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def plain_edit(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_row(doc_id, text):
    w = plain_edit(doc_id, text)
    found = plain_runs(w)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_collapse(w, found))]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def run_corpus():
    rng = random.Random(11)
    rows = [(d, t) for d, t in corpus() if len(t or "") < 20000]
    for k in range(60):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 7))]
        body = unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        rows.append((1000 + k, " ".join([*words(rng, rng.randint(0, 6)).split(), *body, *[rng.choice("abc") for _ in range(rng.randint(0, 12))]])))
    return rows + [(2000, "\x0b".join(["x\x0c"] * 9)), (2001, "é " * 40 + "  " * 8), (2002, " ".join(["wort"] * 3000))]


def test_find_runs_over_many_small_alphabets():
    rng = random.Random(3)
    for _ in range(600):
        texts = [[rng.randrange(k) for _ in range(rng.randint(0, 50))] for k in (1, 2, 3, 2)]
        length, exponent = rng.choice([(6, 4), (2, 2), (5, 3), (10, 2)])
        upto = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        values = mix(np.array([d * 1000 + x for d, w in enumerate(texts) for x in w], np.uint64))
        want = [(int(upto[d]) + s, n, p) for d, w in enumerate(texts) for s, n, p in plain_runs(w, length, exponent)]
        assert [tuple(r) for r in runs.find_runs(values, upto, length, exponent).tolist()] == want


def test_runs_of_less_than_two_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.uint64), np.array([0, 9]), 2, 1)


def test_runs_query_equals_plain_version(spark, tmp_path):
    rows = run_corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in QUERIES["op12_descending_lcp_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((run_row(d, t) for d, t in rows), key=repr)
    assert sum(r[1] for r in got) > 30 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)


def test_runs_of_an_empty_table_and_of_other_columns(spark):
    assert runs.word_runs(frame(spark, []).limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "a a a a a a b", 1, 2, "c")], "doc_id long, text string, runs int, start int, collapsed string")
    assert [tuple(r) for r in runs.word_runs(clash).collect()] == [(1, [(0, 6, 1)], "a b")]


# -- hard negatives ------------------------------------------------------------


def plain_mine(rows, anchors, positives=5, negatives_=5, share=(80, 100)):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in best.items():
        if a % anchors:
            continue
        ranked = sorted((-score(v, w), i, kind) for i, (kind, w) in best.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [(n, t) for n, t, kind in ranked if kind != label and share[0] * -s <= share[1] * -n <= share[1] * -s]
            out += [(a, p, k + 1, t, -s, -n) for k, (n, t) in enumerate(fit[:negatives_])]
    return sorted(out)


def vectors(rng, n, width, spread):
    return [[int(rng.gauss(20, spread)) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("spread, block", [(3, 4), (30, 5), (30, 4096)])
def test_mining_equals_plain_version(spark, spread, block):
    rng = random.Random(spread)
    vs = vectors(rng, 150, 6, spread)
    vs[7] = vs[8] = vs[9] = vs[10]
    rows = [(k, k % 3, v) for k, v in enumerate(vs)]
    rows += [(None, 1, vs[0]), (200, None, vs[0]), (201, 1, None), (12, 2, vs[3]), (12, 0, vs[4]), (203, 1, []), (204, 1, vs[5][:3]), (210, 9, vs[6])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "id long, label int, vector array<long>, rank string, anchor int, score int").repartition(3)
    got = negatives.mine(df, F.col("id") % 7 == 0, anchors=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_mine(rows, 7)


def test_mining_of_an_empty_table_and_of_long_vectors(spark):
    schema = "id long, label int, vector array<long>"
    empty = negatives.mine(spark.createDataFrame([], schema), F.col("id") % 7 == 0)
    assert empty.collect() == [] and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    big = [(k, k % 2, [2**28 + k, 2**27 - 3 * k, k]) for k in range(12)]
    got = negatives.mine(spark.createDataFrame(big, schema), F.col("id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_mine(big, 5)
    with pytest.raises(Exception, match="too long"):
        negatives.mine(spark.createDataFrame([(0, 0, [2**40]), (1, 0, [1])], schema), F.col("id") % 5 == 0).collect()


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (4, 16))
    anchors = np.concatenate([c + rng.integers(-3, 4, (20, 16)) for c in centres])
    rows = np.concatenate([c + rng.integers(-40, 41, (200, 16)) for c in centres])
    tree, asked = negatives.Tree(anchors), 0
    exact = rows @ anchors.T

    def wanted(at, low, high):
        assert (low <= exact[:, at]).all() and (exact[:, at] <= high).all()
        return high >= np.sort(exact[:, at])[-5]

    for at, found, scores in negatives.intervals(tree, anchors, rows, wanted):
        assert (exact[found, at] == scores).all() and len(found) >= 5
        asked += len(found)
    assert sorted(tree.order) == list(range(80)) and asked < rows.shape[0] * 80 / 3


def test_negatives_query_equals_its_sql(spark, sf_dir):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    want = duckdb.sql(ORACLES["op11_anchor_tree_negatives"])
    got = QUERIES["op11_anchor_tree_negatives"](spark, sf_dir)
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())


def test_components_become_longs_or_nothing(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>").select("i", negatives.whole_components(F.col("v")).alias("v"))
    assert {r["i"]: r["v"] for r in df.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# -- near-duplicates -----------------------------------------------------------


def shingles(text, size=4):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_components(rows, size=4, least=80):
    """rows: (key, text) by ascending key; the least key of each component."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i in range(j):
            a = sets[i]
            if a and b:
                both = len(a & b)
                if 100 * both >= least * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(rows))], [len(s) for s in sets]


def families(rng):
    """Chains of copies, one vocabulary in many orders, extended and cut copies around the threshold."""
    out = []
    for _ in range(4):
        text = words(rng, 120).split()
        for _ in range(12):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = words(rng, 1)
        out.append(" ".join(text[: rng.randint(90, 118)]))
        out.append(" ".join(text + words(rng, rng.randint(5, 40)).split()))
    bag = words(rng, 30).split()
    for _ in range(20):
        rng.shuffle(bag)
        out.append(" ".join(bag))
    out += [out[0].upper(), out[1].replace(" ", "\n"), "one two three", "One two three", "one two", " ", " "]
    return out


def test_minhash_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = unique(corpus()) + [(100 + k, t) for k, t in enumerate(families(rng))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ordered = sorted(rows)
    root, n = plain_components([(d, t) for d, t in ordered])
    want = {d: (n[k], ordered[root[k]][0], root[k] == k) for k, (d, _) in enumerate(ordered)}
    got = QUERIES["op13_tensored_minhash"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    assert len({c for _, c, _ in want.values()}) < len(rows) - 30


@pytest.mark.parametrize("long", [2, 4096])
def test_minhash_with_repeated_ids_and_split_lists(spark, monkeypatch, long):
    monkeypatch.setattr(minhash, "LONG", long)
    monkeypatch.setattr(minhash, "STAR", 3)
    rng = random.Random(9)
    rows = corpus() + [(7, t) for t in families(rng)[:30]]
    docs = frame(spark, rows)
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    root, n = plain_components(ordered)
    got = sorted((repr(tuple(r)) for r in minhash.near_duplicates(docs).collect()))
    assert got == sorted(repr((d, n[k], ordered[root[k]][0], root[k] == k)) for k, (d, _) in enumerate(ordered))


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_a_pair_that_no_star_joins_is_found(spark):
    # the middle text links both ends, which are not alike themselves
    base = [f"w{k}" for k in range(200)]
    left, right = [*base], [*base]
    left[10:14] = ["l1", "l2", "l3", "l4"]
    left[60:64] = ["l5", "l6", "l7", "l8"]
    right[120:124] = ["r1", "r2", "r3", "r4"]
    right[180:184] = ["r5", "r6", "r7", "r8"]
    rows = [(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(base)), (4, "other words of its own kind")]
    assert not plain_components([rows[0], rows[1]])[0] == [0, 0]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_missed_share_is_as_stated():
    miss = lambda s: 1 - (1 - (1 - s**minhash.GROUP) ** minhash.TABLES) ** 2
    below = sum(math.comb(minhash.HASHES, k) * 0.8**k * 0.2 ** (minhash.HASHES - k) for k in range(minhash.AGREE))
    assert miss(0.8) < 1.3e-6 and miss(0.85) < 4e-8 and below < 1.3e-7


def test_sketches_agree_as_often_as_sets_are_alike(spark):
    base = [f"w{k}" for k in range(1003)]
    other = [*base[:880], *[f"x{k}" for k in range(123)]]
    rows = keyed(frame(spark, [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base).upper())]))
    got = {r["key"]: r for r in minhash.sketches(rows, 4).collect()}
    sig = minhash.matrix(pa.array([bytes(got[k]["sig"]) for k in (1, 2, 3)]))
    assert (sig[0] == sig[2]).all() and got[1]["keys"] == got[3]["keys"] and got[1]["w1"] == got[3]["w1"]
    assert 32 <= (sig[0] == sig[1]).sum() <= 54
