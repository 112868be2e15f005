"""Compare registered queries with their check SQL.

    python -m tests.harness [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def kind(v):
    return type(v).__name__


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    cols = df.columns
    if sql is None:
        return "rows", f"{len(got)} rows", t_spark, 0.0
    t0 = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t_duck = time.time() - t0
    if sorted(cols) != sorted(want_cols):
        return "FAIL", f"columns {sorted(cols)} vs {sorted(want_cols)}", t_spark, t_duck
    a, b = _rows(cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return "FAIL", (
            f"rows {len(a)} vs {len(b)}; cols {sorted(cols)}\n spark-only {list(sa - sb)[:2]}"
            f"\n sql-only {list(sb - sa)[:2]}"
        ), t_spark, t_duck
    diff = [(x, y) for x, y in zip(a, b) if x != y or [kind(i) for i in x] != [kind(i) for i in y]]
    if diff:
        sa, sb = set(a), set(b)
        return "FAIL", (
            f"{len(diff)} of {len(a)} rows differ; cols {sorted(cols)}\n spark {list(sa - sb)[:2] or diff[0][0]}"
            f"\n sql   {list(sb - sa)[:2] or diff[0][1]}"
        ), t_spark, t_duck
    return ("EMPTY" if not a else "ok"), f"{len(a)} rows", t_spark, t_duck


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args(argv)
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from triagelens.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("harness", "8")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = []
    for n in names:
        try:
            status, note, ts, td = compare(spark, con, n, queries[n], sqls.get(n), sf_dir)
        except Exception as exc:  # report and go on with the next query
            status, ts, td = "ERROR", 0.0, 0.0
            note = str(exc)[:1500] if "-v" not in sys.argv else traceback.format_exc()
        if status not in ("ok", "rows"):
            bad.append(n)
        print(f"{status:5} {n:34} spark {ts:6.2f}s duck {td:6.2f}s {note}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
