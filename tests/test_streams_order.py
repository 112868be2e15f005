"""Stateful streams give the same rows for one batch and for several files out of order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from triagelens.operators import replay as RP
from triagelens.session import work_path
from triagelens.sources.streams import event_stream
from triagelens.streaming import alerts as AL
from triagelens.streaming import audit as AU
from triagelens.streaming import slo as SL

START = dt.datetime(2024, 1, 1)


def in_files(spark, rows, schema, parts):
    """A folder with one file for each list of row numbers."""
    path = work_path(spark, "ordered")
    for part in parts:
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def shuffled(n, parts, reach, seed):
    """Row numbers in ``parts`` lists, each row at most ``reach`` places from its own."""
    rng = random.Random(seed)
    order = sorted(range(n), key=lambda k: k + rng.random() * reach)
    size = -(-n // parts)
    return [order[k * size : (k + 1) * size] for k in range(parts)]


def test_alerts_do_not_depend_on_batches(spark):
    rng = random.Random(4)
    rows = [("A" if k % 2 else "B", "svc", START + dt.timedelta(minutes=5 * (k // 2)), rng.random() < 0.8, 600) for k in range(240)]
    schema = "alertname string, service string, window_end timestamp, breached boolean, hold_seconds int"
    got = []
    for parts in ([range(240)], shuffled(240, 4, 20, 1)):
        path = in_files(spark, rows, schema, parts)
        out = SL.run_available(AL.firing_stream(event_stream(spark, path, max_files=1), 300, "2 hours"), "firing")
        got.append(sorted(tuple(r) for r in out.collect()))
    evals = spark.createDataFrame([(*r, "s", "l", "o") for r in rows], schema + ", severity string, slo string, owner string")
    last = max(r[2] for r in rows if r[3]) - dt.timedelta(hours=2)
    want = AL.firing(evals, 300).where(F.col("window_end") < F.lit(last)).select("alertname", "service", "window_end", "active_seconds")
    assert got[0] == got[1] == sorted(tuple(r) for r in want.collect())
    assert len(got[0]) > 40


def plain_cases(rows, now, deadline, idle):
    out, by = [], {}
    for h, t, c, s, at in sorted((r for r in rows if r[4] < now), key=lambda r: (r[0], r[4], r[2])):
        by.setdefault(h, []).append((at, t, s))
    d, i = dt.timedelta(seconds=deadline), dt.timedelta(seconds=idle)
    for h, changes in by.items():
        case = None
        for at, t, s in [*changes, (now, None, None)]:
            if case and not case[4] and case[2] + d < at:
                case[4] = True
                out.append((h, case[0], "overdue", case[1], case[2], case[2] + d, deadline))
            if case and case[3] + i < at:
                out.append((h, case[0], "expired", case[1], case[2], case[3] + i, int((case[3] + i - case[2]).total_seconds())))
                case = None
            if s is None:
                continue
            case = [t, s, case[2] if case else at, at, case[4] if case else False]
            if s in AU.DONE:
                out.append((h, t, "resolved", s, case[2], at, int((at - case[2]).total_seconds())))
                case = None
    return sorted(out)


def test_handoff_cases_do_not_depend_on_batches(spark):
    rng = random.Random(6)
    rows = []
    for k in range(160):
        at = START + dt.timedelta(hours=k)
        rows.append((f"h{rng.randrange(12)}", "t1", f"c{k:03}", rng.choice(["open", "in_review", "in_review", "resolved", "closed"]), at))
    schema = "handoff_id string, tenant_id string, change_id string, queue_status string, changed_at timestamp"
    now = rows[-1][4] - dt.timedelta(hours=24)
    want = plain_cases(rows, now, 10 * 3600, 20 * 3600)
    for parts in ([range(160)], shuffled(160, 4, 15, 2)):
        path = in_files(spark, rows, schema, parts)
        out = SL.run_available(AU.handoff_cases(event_stream(spark, path, max_files=1), "24 hours", 10 * 3600, 20 * 3600), "cases")
        assert sorted(tuple(r) for r in out.collect()) == want
    assert {r[2] for r in want} == {"resolved", "overdue", "expired"}


def test_idle_time_shorter_than_the_deadline_is_refused(spark):
    with pytest.raises(ValueError):
        AU.handoff_cases(None, "1 hour", 10, 5)


@pytest.mark.parametrize("a, b, same", [
    ('{"a":"1"}', '{"a":1}', False), ('{"a":"true"}', '{"a":true}', False), ('{"a":"{\\"b\\":1}"}', '{"a":{"b":1}}', False),
    ('{"a":{"c":1,"b":[1,2]}}', ' {"a" : {"b":[1,2],"c":1}} ', True), (None, "{}", True), ("no json", "no json", True), ("no json", "other", False)])
def test_contexts_are_compared_with_their_types(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select((RP._canonical_json(F.col("a")) == RP._canonical_json(F.col("b"))).alias("same")).first()["same"] is same
