"""What the review of the third round found."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import harness
from tests.test_streams_order import in_files, plain_cases, shuffled
from triagelens.catalog import all_oracles, all_queries
from triagelens.functions import backends as B
from triagelens.functions import quality as Q
from triagelens.functions import safety as P
from triagelens.functions import stems as ST
from triagelens.functions import text as X
from triagelens.functions import tokens as TK
from triagelens.operators import postings as PO
from triagelens.operators import replay as RP
from triagelens.operators import retrieval as R
from triagelens.sources.streams import event_stream
from triagelens.streaming import audit as AU
from triagelens.streaming import slo as SL

NAMES = ["faithfulness", "relevance", "citation_coverage", "hallucination_ratio"]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rows = [("a", *[v] * 4) for v in [0.1] * 10] + [("b", 0.7, 0.7, None, 0.7), ("b", 0.1, 0.1, None, 0.1), ("b", 0.1, 0.1, 0.3, 0.1)]
    scored = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in NAMES)).coalesce(1)
    got = {r["k"]: r for r in Q.quality_report(scored, ["k"]).collect()}
    assert [got["a"][n] for n in NAMES] == [0.1] * 4 and got["a"]["answers"] == 10
    assert got["b"]["relevance"] == 0.3 and got["b"]["citation_coverage"] == 0.3


def test_drift_is_evaluated_every_five_minutes(spark, sf_dir):
    ends = {r["window_end"][14:16] for r in all_queries()["st_input_confidence_drift"](spark, sf_dir).select("window_end").distinct().collect()}
    assert ends == {f"{m:02}" for m in range(0, 60, 5)}


def test_hand_off_state_is_kept_by_bucket(spark):
    """A call for each bucket, not for each hand-off: far fewer keys than hand-offs, the same rows."""
    start = dt.datetime(2024, 1, 1)
    rows = [(f"h{k % 900}", "t", f"c{k:05}", ["open", "in_review", "resolved"][k * 7 % 3], start + dt.timedelta(minutes=10 * k)) for k in range(2700)]
    schema = "handoff_id string, tenant_id string, change_id string, queue_status string, changed_at timestamp"
    path = in_files(spark, rows, schema, shuffled(2700, 3, 60, 5))
    kept = []
    for buckets in (1, 16):
        frame = AU.handoff_cases(event_stream(spark, path, max_files=1), "24 hours", 10 * 3600, 40 * 3600, buckets)
        kept.append(sorted(tuple(r) for r in SL.run_available(frame, "cases").collect()))
    assert kept[0] == kept[1] == plain_cases(rows, rows[-1][4] - dt.timedelta(hours=24), 10 * 3600, 40 * 3600)
    assert len({r[0] for r in kept[0]}) > 800


@pytest.mark.parametrize("k, tile", [(1, 3), (4, 7), (5, 64), (40, 7)])
def test_tiles_give_the_best_columns_with_ties_to_the_earlier(k, tile):
    rng = np.random.default_rng(k)
    m = rng.integers(0, 4, (23, 31)) / 7
    got = R._best_of(lambda q, c: m[np.ix_(q["i"], c["i"])], pd.DataFrame({"i": range(23)}), pd.DataFrame({"i": range(31)}), k, tile)
    want = [(r, c, v) for r in range(23) for c, v in sorted(enumerate(np.round(m[r], 9)), key=lambda x: (-x[1], x[0]))[:k]]
    assert list(zip(*(x.tolist() for x in got))) == want


def test_blocks_grow_so_that_rows_are_repeated_less(spark):
    """2,000 rows in blocks of 10: 200 repeats of each row before, 13 now."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("request_id"), F.lit("t").alias("tenant_id"))
    assert R._blocked(df, ["tenant_id"], "request_id", 10, 16, "b").agg(F.max("n_b")).first()[0] == 13
    assert R._blocked(df, ["tenant_id"], "request_id", 900, 16, "b").agg(F.max("n_b")).first()[0] == 3


def test_style_examples_share_no_row_for_each_common_word(spark):
    """One word in all texts: the join by words made 40,000 rows of 200 requests and 200 examples; blocks make two rows a request."""
    rq = spark.createDataFrame([(f"r{k:03}", f"refund case{k}", "", "") for k in range(200)], "request_id string, issue_text string, preferred_tone string, channel string")
    ex = spark.createDataFrame([(k, f"refund case{k}", "friendly", "chat") for k in range(200)], "example_id long, customer_text string, tone string, channel string")
    frame = RP.style_examples(rq, ex, 2)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "token" not in plan and "explode(q_feat" not in plan
    got = {(r.request_id, r["rank"]): (r.example_id, r.score) for r in frame.collect()}
    assert len(got) == 400 and all(got[(f"r{k:03}", 1)] == (k, 1.0) and got[(f"r{k:03}", 2)] == (int(k == 0), 0.5) for k in range(200))


def test_entropy_is_one_narrow_pass(spark):
    texts = ["", None, "aab", "ABab", "é😀é", "x" * 5000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.char_entropy(F.col("t")).alias("e"))

    def plain(t):
        low = (t or "").lower()
        return -sum(low.count(c) / len(low) * math.log2(low.count(c) / len(low)) for c in set(low)) + 0.0

    assert [round(r["e"], 9) for r in df.collect()] == [round(plain(t), 9) for t in texts]
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_set_difference_joins_sets(spark, sf_dir):
    """The side that the join holds is a set before, so no task holds the rows of a tenant."""
    for name, join in (("set_difference", "LeftAnti"), ("set_intersection", "LeftSemi")):
        plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.index(join):], name


def test_sparse_matches_look_up_only_terms_that_are_asked(spark, monkeypatch):
    texts = {"c1": "alpha beta gamma gamma", "c2": "alpha beta", "c3": "alpha noise", "c4": "noise more noise"}
    chunks = spark.createDataFrame([(k, "t", None, v) for k, v in texts.items()], "chunk_id string, tenant_id string, section string, text_content string")
    asked = {"r1": "alpha", "r2": "beta alpha", "r3": "gamma alpha beta", "r4": "alpha missing", "r5": ""}
    rq = spark.createDataFrame([(k, "t", None, v) for k, v in asked.items()], "request_id string, tenant_id string, scope string, issue_text string")
    staged = []
    keep = R.stage
    monkeypatch.setattr(R, "stage", lambda df, name: staged.append(keep(df, name)) or staged[-1])
    got = {(r["request_id"], r["chunk_id"]): r["sparse_score"] for r in R.sparse_matches(rq, R.inverted_index(chunks)).collect()}
    want = {}
    for r, a in asked.items():
        for c, t in texts.items():
            tf = [t.split().count(w) for w in a.split()]
            if tf and all(tf):
                want[(r, c)] = round(sum(n / (n + 1.0) for n in tf), 9)
    assert got == want and len(want) == 6
    assert {r["token"] for r in staged[0].collect()} == {"alpha", "beta", "gamma"}


def test_a_full_memory_of_tokens_costs_no_more():
    """Once 262,144 tokens were known, each new one walked over all that had been dropped: 20 times the time for five times the texts."""
    def seconds(first, count):
        start = time.perf_counter()
        for k in range(first, first + count, 100):
            model([" ".join(f"t{i}" for i in range(k, k + 100))])
        return time.perf_counter() - start

    model = B.hash_model(8)()
    before = seconds(0, 200_000)
    assert seconds(200_000, 400_000) < 8 * before
    assert np.array_equal(model(["alpha beta alpha"]), B.hash_model(8)()(["alpha beta alpha"]))


def test_words_are_taken_out_of_a_text(spark):
    """Replacing what lies between words took twenty times as long as taking the words."""
    texts = ["  It's &amp; that's’s  sooooo #Cool @you http://x.y __mask__ \U0001f600 été 12-3 ", "", None, " \n ", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(X.tokenize(F.col("t")), X.normalize_text(F.col("t"))).collect()]
    low = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.col("t"), "https?://\\S+|@\\w+|#|__[a-z_]+__", " ")), "[’]", "'"), "&amp;", " and ")
    old = [r[0] or "" for r in df.select(F.trim(F.regexp_replace(F.regexp_replace(low, r"(.)\1{3,}", "$1$1"), "[^a-z0-9']+", " "))).collect()]
    assert [n for _, n in got] == old and [w for w, _ in got] == [n.split() for n in old]
    plan = df.select(X.tokenize(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9']" not in plan


def test_words_of_chunks_are_not_repeated_for_each_request(spark):
    """Evidence used to be dealt out by request together with the words and word pairs of its chunks, three times."""
    texts = {"c1": "a b c d e f g h i j", "c2": "a b c d e f g h i k", "c3": "x y z", "c4": "a a b"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text_content string")
    rows = [(r, c, k + 1, round(1 - k / 10, 1)) for r in ("q", "r") for k, c in enumerate(texts)]
    evidence = spark.createDataFrame(rows, "request_id string, chunk_id string, rank int, score double")
    words = R.chunk_words(chunks)
    thin = R.near_dup_greedy(evidence, 0.8, words=words)
    assert sorted(thin.select("request_id", "chunk_id", "rank").collect()) == [(r, c, k) for r in "qr" for c, k in (("c1", 1), ("c3", 3), ("c4", 4))]
    wide = R.near_dup_greedy(evidence.join(words, "chunk_id"), 0.8)
    assert sorted(thin.collect()) == sorted(wide.select(*thin.columns).collect())
    asked = R.request_words(spark.createDataFrame([("q", "a b x"), ("r", "")], "request_id string, issue_text string"))
    plan = R.rerank(thin.join(asked, "request_id").join(words, "chunk_id"), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and not any("RepartitionBy" in a and ("words" in b or "g2" in b) for a, b in zip(plan.splitlines(), plan.splitlines()[1:]))


TEXTS = ["", "  ", "Refunds, refunding: the refund!", "\u00e9t\u00e9 na\u00efve 12-3", "x" * 300, "a", None, "Ordering orders\nordered", "the of", "!a b!"]


def plain_tokens(texts):
    return [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_tokens_are_found_in_the_bytes_of_many_texts(monkeypatch, size):
    monkeypatch.setattr(TK, "PART", size)
    low = [(t or "").lower() for t in TEXTS]
    batch = pa.RecordBatch.from_arrays([pa.array(low), pa.array(range(len(low)))], ["text", "k"]).slice(1)
    got = []
    for part in TK.parts([batch], "text"):
        rows, position, word, words = TK.tokens_of(part.column("text"))
        got += [(part.column("k")[r].as_py(), p, words[w].as_py()) for r, p, w in zip(rows.tolist(), position.tolist(), word.tolist())]
    assert got == [(k, p, w) for k, ws in enumerate(plain_tokens(low)) for p, w in enumerate(ws)]


def test_stems_in_python_equal_those_in_spark(spark):
    rng = random.Random(5)
    ends = ["", "s", "ing", "ed", "edly", "ational", "ement", "ion", "ative", "e", "ll", "y", "ly", "ogi", "ies", "ied", "ous", "eed", "ss"]
    words = sorted({"".join(rng.choice("aeiouybstlengd") for _ in range(rng.randint(1, 9))) + rng.choice(ends) for _ in range(2000)} | {"y", "yy", "ayay", "x9"})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", ST.stem(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == {w: ST.stem_word(w) for w in words}


def test_a_long_word_without_an_ending_is_not_tried_at_every_letter():
    """The regions were looked for in words without the ending, with work that grew with the cube of a word's length."""
    start = time.perf_counter()
    assert ST.stem_word("ab" * 5000) == "ab" * 5000
    assert time.perf_counter() - start < 2


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_postings_are_made_where_a_text_is_read(spark, monkeypatch, size):
    """Words used to be shuffled, staged with their positions and shuffled again for their stems."""
    monkeypatch.setattr(PO, "stage", None)
    monkeypatch.setattr(TK, "PART", size)
    rows = [(f"c{k}", [None, "t2", "t1"][k % 3], "s" if k % 2 else None, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "chunk_id string, tenant_id string, section string, text_content string")
    want = {}
    for (chunk, tenant, section, _), words in zip(rows, plain_tokens(TEXTS)):
        for p, w in enumerate(words):
            if w not in ST.STOP_WORDS:
                want.setdefault((tenant, section, chunk, ST.stem_word(w)), []).append(p)
    got = [tuple(r) for r in PO.build_postings(df).collect()]
    assert {r[:4]: list(r[4]) for r in got} == want and len(got) == len(want)
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (
        [r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows], [(t or "").lower() for t in TEXTS])], ["tenant_id", "section", "chunk_id", "text"])
    for part in PO._term_positions(iter([batch])):
        order = [(r["tenant_id"] or "", r["term"], r["chunk_id"]) for r in part.to_pylist()]
        assert order == sorted(order)


def test_matches_are_dealt_out_by_request_and_chunk(spark):
    """All covers were added up in as few tasks as their bytes filled: one task for 0.1 GB of texts."""
    chunks = spark.createDataFrame([("c1", "t", None, "late order")], "chunk_id string, tenant_id string, section string, text_content string")
    asked = spark.createDataFrame([("q", "t", None, "order late")], "request_id string, tenant_id string, scope string, issue_text string")
    found = PO.cover_matches(asked, PO.build_postings(chunks))
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1


@pytest.mark.parametrize("name", ["hash_embedding", "embedding_backend"])
def test_a_text_without_tokens_has_no_sum(spark, tmp_path, name):
    """It gave 0.0 where the SQL has null."""
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(["one two two", "", None, "\u00e9 \u65e5\u672c !?", "a"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert harness.compare(spark, con, name, all_queries()[name], all_oracles()[name], str(tmp_path))[:2] == ("ok", "5 rows")
