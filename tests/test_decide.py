"""The decide plan on micro-batches: repeated batches, replay and sanitized drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelens import adapters as A
from triagelens.functions import backends as B
from triagelens.plans import decide as D
from triagelens.session import work_path
from triagelens.streaming import decide as DS

CFG = D.DecideConfig(as_of="2025-02-01", canary_percent=30)


def test_a_repeated_batch_changes_nothing(spark, sf_dir):
    requests = A.support_requests(spark, sf_dir).where(F.length("issue_text") % 3 == 0).withColumn("context", F.lit('{"a":1}'))
    packs = A.simple_packs(spark, sf_dir).withColumn("evidence", F.transform("evidence", lambda e: e.withField("text", F.concat(F.lit("Write to jane.doe@example.com. "), e["text"]))))
    first = [r["request_id"] for r in requests.orderBy("request_id").limit(2).collect()]
    stored = requests.where(F.col("request_id").isin(first)).withColumn("context", F.when(F.col("request_id") == first[0], '{ "a": 1 }').otherwise('{"a":"1"}'))
    out = work_path(spark, "twice")
    each = DS.decide_each(A.doc_chunks(spark, sf_dir), CFG, out, stored.withColumn("response", F.lit("earlier")), packs)
    seen = []
    for _ in range(2):
        each(requests, 0)
        seen.append({n: sorted(map(repr, DS.decided_rows(spark, out, n).collect())) for n in (*DS.OUTPUTS, "replayed")})
    assert seen[0] == seen[1] and all(seen[0][n] for n in ("results", "shadow", "events", "audit"))
    n = requests.count()
    # the context of the second request differs in the type of a value, so it is decided again
    assert len(seen[0]["replayed"]) == 1 and len(seen[0]["results"]) == len(seen[0]["audit"]) == n - 1
    drafts = DS.decided_rows(spark, out, "results").where("draft is not null")
    assert drafts.count() > 0 and drafts.where(F.col("draft").contains("jane.doe")).count() == 0
    assert DS.decided_rows(spark, out, "audit").where("draft_violations > 0").count() == drafts.where("draft_violations > 0").count() > 0


def test_models_that_fail_leave_the_route_to_the_fallback(spark, sf_dir):
    def broken():
        import numpy as np

        return lambda lists: np.array([[float("nan")] * 5 if k % 2 else [1.0, 0, 0, 0, 0] for k, _ in enumerate(lists)])

    requests = A.support_requests(spark, sf_dir).limit(6).coalesce(1)
    got = B.ArrowRouter(broken).add(requests).select("route_probs").collect()
    assert [r["route_probs"] is None for r in got] == [False, True] * 3
    assert all(abs(sum(r["route_probs"]) - 1) < 1e-9 for r in got if r["route_probs"])


def test_both_embedding_backends_agree(spark):
    df = spark.createDataFrame([("a", "Refund my order, refund it"), ("b", ""), ("c", None), ("d", "x y z x")], "k string, t string")
    one = {r["k"]: r["v"] for r in B.HashEmbedding(16).add(df, "k", "t", "v").collect()}
    two = {r["k"]: r["v"] for r in B.ArrowEmbedding(B.hash_model(16), 16).add(df, "k", "t", "v").collect()}
    assert one.keys() == two.keys() and all(abs(x - y) < 1e-12 for k in one for x, y in zip(one[k], two[k]))
