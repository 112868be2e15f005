"""Inputs of any depth, and stateful streams in a session without the library's settings."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from triagelens.operators import lifecycle as L
from triagelens.operators import replay as RP
from triagelens.sources import feeds as FD


def test_conversation_lists_nest_to_any_depth(spark, tmp_path):
    record: dict = {"text": "l6"}
    for k in range(5, 0, -1):
        record = {"text": f"l{k}", "turns": [record]}
    path = tmp_path / "talk.jsonl"
    path.write_text(json.dumps(record) + "\n" + json.dumps({"dialogue": [[{"text": "inner"}, [{"text": "innermost"}]]]}) + "\nnot json\n")
    got = sorted(r.text for r in FD.conversations(spark, str(path)).collect())
    assert got == ["inner", "innermost", "l1", "l2", "l3", "l4", "l5", "l6"]


def test_lineage_of_150_steps_and_a_cycle(spark):
    rows = [(f"a{k:03}", f"a{k - 1:03}" if k else None) for k in range(151)] + [("x", "y"), ("y", "z"), ("z", "x"), ("lost", "nowhere")]
    a = spark.createDataFrame(rows, "artifact_id string, parent_id string")
    roots = spark.createDataFrame([("a150",), ("x",), ("lost",), ("absent",)], "artifact_id string")
    got = {tuple(r) for r in L.lineage_chain(a, roots).collect()}
    want = {("a150", f"a{150 - k:03}", k) for k in range(151)} | {("x", "x", 0), ("x", "y", 1), ("x", "z", 2), ("lost", "lost", 0)}
    assert got == want


def test_style_examples_are_positive_where_one_is(spark):
    rq = spark.createDataFrame([("r1", "refund my broken parcel", "", ""), ("r2", "zzz qqq", "", "")], "request_id string, issue_text string, preferred_tone string, channel string")
    ex = spark.createDataFrame([(1, "broken parcel arrived", "a", "friendly", "chat"), (2, "unrelated words", "b", "terse", "mail")], "example_id long, customer_text string, agent_text string, tone string, channel string")
    got = {(r.request_id, r.example_id) for r in RP.style_examples(rq, ex, 2).collect()}
    assert got == {("r1", 1), ("r2", 1), ("r2", 2)}


def test_nested_contexts_replay_whatever_the_key_order(spark):
    cols = "request_id string, tenant_id string, section string, issue_text string, risk_level string, context string"
    rq = spark.createDataFrame([("1", "t", None, "i", "low", '{"a": {"x": 1, "y": [1, {"p": 2, "q": 3}]}}')], cols)
    st = spark.createDataFrame([("1", "t", None, "i", "low", '{"a":{"y":[1,{"q":3,"p":2}],"x":1}}', "done")], cols + ", response string")
    hits, fresh = RP.idempotent_replay(rq, st)
    assert (hits.count(), fresh.count()) == (1, 0)


PLAIN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
import __spark_entry__ as e
for name in ("st_alerts_stateful", "st_failure_trips"):
    print("ROWS", name, e.queries()[name](spark, sys.argv[1]).count())
"""


def test_stateful_streams_in_a_plain_session(sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", PLAIN, sf_dir], cwd=root, capture_output=True, text=True, timeout=300)
    rows = {x.split()[1]: int(x.split()[2]) for x in out.stdout.splitlines() if x.startswith("ROWS")}
    assert len(rows) == 2 and all(rows.values()), out.stderr[-2000:]
