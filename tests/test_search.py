"""Corpus duplicates, cell index, stems and cover density against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.functions import stems as ST
from triagelens.operators import duplicates as DU
from triagelens.operators import postings as PO
from triagelens.operators import vectors as VX
from triagelens.operators.graph import components


def plain_groups(items, threshold):
    sets = [(k, set(t)) for k, t in sorted(items)]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and len(s & t) / max(len(s), len(t)) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), len(s), find(k) == k) for k, s in sets}


def families(rng):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(6):
        words = rng.sample(vocabulary, rng.choice([4, 12, 40, 90]))
        for _ in range(9):
            out.append(list(words))
            for _ in range(rng.randint(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    hot = [f"hot{k}" for k in range(30)]
    out += [hot[: rng.randint(22, 30)] for _ in range(25)]
    return [(f"c{k:03}", sorted(set(t))) for k, t in enumerate(out)] + [("e1", []), ("e2", []), ("x1", out[0]), ("x2", out[0])]


@pytest.mark.parametrize("threshold, long", [(0.85, 4096), (0.85, 3), (0.6, 5)])
def test_corpus_duplicates_equal_all_pairs(spark, monkeypatch, threshold, long):
    monkeypatch.setattr(DU, "LONG", long)
    items = families(random.Random(3))
    df = spark.createDataFrame(items, "chunk_id string, terms array<string>").repartition(3)
    got = DU.near_dup_corpus(df, "chunk_id", F.col("terms"), threshold).collect()
    assert {r["chunk_id"]: tuple(r)[1:] for r in got} == plain_groups(items, threshold)


def test_corpus_duplicates_of_an_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id string, terms array<string>")
    assert DU.near_dup_corpus(df, "chunk_id", F.col("terms")).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(f"a{k:03}", f"a{k + 1:03}") for k in range(60)] + [("z", f"s{k}") for k in range(20)] + [("q", "q")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"a{k:03}"] for k in range(61)} == {"a000"} and {got[f"s{k}"] for k in range(20)} == {"s0"} and got["z"] == "s0"


def unit_rows(rng, n, dim=8):
    v = rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1)[:, None]).tolist()


def test_cell_index_holds_every_row_and_finds_all_when_all_cells_are_probed(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", "t1" if i % 3 else "t2", "s" if i % 2 else None, v) for i, v in enumerate(unit_rows(rng, 200))] + [("zero", "t1", None, [0.0] * 8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, tenant_id string, section string, c_vec array<double>")
    index = VX.build_index(chunks, 9, 2)
    assert index.rows.count() == 201 and index.rows.select("cell").distinct().count() > 4
    asked = [(f"q{i}", "t1" if i % 2 else "t2", "s" if i % 3 == 0 else None, v) for i, v in enumerate(unit_rows(rng, 30))]
    requests = spark.createDataFrame(asked, "request_id string, tenant_id string, scope string, q_vec array<double>")

    def plain(q):
        fit = [(-round(float(np.dot(v, q[3])), 9), c) for c, t, s, v in rows if t == q[1] and (q[2] is None or q[2] == s)]
        return [c for _, c in sorted(fit)[:5]]

    found = VX.index_search(requests, index, 5, 9).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["request_id"], []).append(r["chunk_id"])
    assert got == {q[0]: plain(q) for q in asked}
    some = VX.index_search(requests, index, 5, 4)
    truth = VX.index_search(requests, index, 5, 9)
    share = VX.recall(some, truth, []).first()
    assert 0.5 < share["recall"] < 1.0 and share["wanted"] == 150


def test_index_of_no_rows_and_too_many_cells(spark):
    empty = spark.createDataFrame([], "chunk_id string, tenant_id string, section string, c_vec array<double>")
    assert VX.build_index(empty, 4).rows.count() == 0
    with pytest.raises(ValueError):
        VX.train_centres(empty, "chunk_id", "c_vec", VX.CELLS + 1, 1)


# Words and their stems in the published list of the English rules.
STEMS = dict(
    consigned="consign", consistency="consist", consolation="consol", knightly="knight", caresses="caress", ponies="poni", ties="tie", gas="gas",
    kiwis="kiwi", hoping="hope", hopping="hop", agreed="agre", feed="feed", happy="happi", by="by", say="say", relational="relat", conditional="condit",
    digitizer="digit", operator="oper", hopefulness="hope", formality="formal", sensibility="sensibl", electrical="electr", goodness="good",
    replacement="replac", adoption="adopt", probate="probat", rate="rate", cease="ceas", roll="roll", shipping="ship", youth="youth", enjoying="enjoy",
    filing="file", universities="univers", bed="bed", quickly="quick")


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", ST.stem(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == STEMS


def plain_covers(words, terms):
    last, start, score, places = {}, -1, 0.0, [(p, w) for p, w in enumerate(words) if w in terms]
    for i, (p, w) in enumerate(places):
        last[w] = (p, i)
        if len(last) == len(terms):
            s, si = min(last.values())
            if s > start:
                start = s
                score += 0.1 / (1 + (p - s) - (i - si))
    return round(score, 9)


def test_cover_density(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["refund", "order", "late", "box", "the", "is"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    chunks = spark.createDataFrame([(f"c{k}", "t1", "s", t) for k, t in enumerate(texts)], "chunk_id string, tenant_id string, section string, text_content string")
    asked = [("q1", "t1", "s", "Refunds for the order"), ("q2", "t1", None, "late"), ("q3", "t1", None, "the is"), ("q4", "t2", None, "late"), ("q5", "t1", None, "late unicorn"), ("q6", "t1", "s", "order refunded boxes late")]
    requests = spark.createDataFrame(asked, "request_id string, tenant_id string, scope string, issue_text string")
    got = {(r["request_id"], r["chunk_id"]): r["cover_score"] for r in PO.cover_matches(requests, PO.build_postings(chunks)).collect()}
    want = {}
    for q, terms in (("q1", {"refund", "order"}), ("q2", {"late"}), ("q6", {"order", "refund", "box", "late"})):
        for k, t in enumerate(texts):
            if terms <= set(t.split()):
                want[q, f"c{k}"] = plain_covers(t.split(), terms)
    assert got == want and len(want) > 60
