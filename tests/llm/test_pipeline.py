"""Stages of the corpus pipeline on awkward rows, and the plan of the repeated spans."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from tests.llm import brute as B
from tests.llm.test_operators import corpus, frame
from triagelens.llm import minhash, simhash, suffixes


def test_rows_come_back_whole(spark):
    rows = corpus()
    docs = frame(spark, rows)
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.schema["key"].dataType == docs.schema["key"].dataType
    got = cut.collect()
    assert len(got) == len(rows) and sum(r["text"] is None for r in got) == sum(t is None for _, t in rows)
    assert all((r["key"], r["marks"], r["row"], r["fp"]) == (1, "m", 2, 4) for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and sum(r["text"] is None for r in kept.collect()) == sum(t is None for _, t in rows)


def test_texts_are_shuffled_once(spark):
    docs = frame(spark, [(k, f"text {k} " + "same words again and again " * 8) for k in range(40)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffixes.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    carries = [k for k, line in enumerate(lines) if "Exchange hashpartitioning" in line and "Reused" not in line and any("text" in x and "Project" in x for x in lines[k + 1 : k + 2])]
    reused = [line for line in lines if "ReusedExchange" in line and "text" in line]
    assert len(carries) <= 1 and len(reused) >= 2


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[1:3]])
def test_stage_of_an_empty_table(spark, name):
    docs = frame(spark, []).limit(0)
    out = dict(P.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns and out.count() == 0


def test_repeated_spans_stage_equals_plain_version(spark):
    rows = [(d, t) for d, t in corpus() if d is not None and d != 4]
    got = {r["doc_id"]: r["text"] for r in P.repeated_spans(spark, frame(spark, rows), "").collect()}
    want = {}
    for doc_id, raw, flags in B.gone(rows, str.encode, 100):
        text, out, at = raw.decode(), [], 0
        for ch in text:
            size = len(ch.encode())
            if not all(flags[at : at + size]):
                out.append(ch)
            at += size
        want[doc_id] = "".join(out)
    null = {d for d, t in rows if t is None}
    assert got == {d: None if d in null else t for d, t in want.items() if d in null or t != ""}


def test_near_duplicates_come_from_the_index(spark, monkeypatch):
    """With nothing from the exact check that follows, the fingerprints' partners alone join near copies; before, they had no part in it."""
    base = [f"word{k * k % 977}x{k}" for k in range(3000)]
    near = [*base[:1500], "changed", *base[1501:]]
    other = [f"other{k}" for k in range(3000)]
    docs = frame(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(near).upper()), (5, None)])
    pairs = {tuple(r) for r in simhash.fingerprint_pairs(simhash.keyed(docs)).collect()}
    assert pairs == {(1, 2), (2, 4)} or pairs == {(1, 2), (1, 4)}
    real = minhash.candidates
    monkeypatch.setattr(minhash, "candidates", lambda sets, many, least: real(sets.limit(0), many, least))
    assert sorted(r["doc_id"] for r in simhash.first_of_each(docs).collect()) == [1, 3, 5]


def test_proposed_pairs_below_the_similarity_join_nothing(spark):
    rows = [(k, " ".join(f"w{k}_{i}" for i in range(40))) for k in range(6)] + [(9, " ".join(f"w0_{i}" for i in range(40)) + " end")]
    docs = simhash.keyed(frame(spark, rows))
    proposed = spark.createDataFrame([(0, 1), (1, 2), (0, 9), (9, 9)], "a long, b long")
    got = {r["key"]: r["root"] for r in minhash.similar_sets(docs, 5, 80, proposed).collect()}
    assert got == {**{k: k for k in range(6)}, 9: 0}
