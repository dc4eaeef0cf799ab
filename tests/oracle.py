"""Compare Spark results with DuckDB on the same parquet files: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (int, str, bool)) or v is None:
        return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got_cols = list(df.columns)
    t0 = time.time()
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    print(f"     {name} spark {took:.1f}s", flush=True) if os.environ.get("TRACE") else None
    if sql is None:
        return True, f"{len(got)} rows (no SQL) {took:.1f}s"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    if got == want:
        return bool(got), f"{len(got)} rows {took:.1f}s" + ("" if got else " EMPTY")
    got_set, want_set = set(got), set(want)
    only_got = [r for r in got if r not in want_set][:2]
    only_want = [r for r in want if r not in got_set][:2]
    return False, f"{len(got)} vs {len(want)}\n   {sorted(got_cols)}\n   spark {only_got}\n   sql   {only_want}"


def main(argv):
    import __spark_entry__ as e
    from rosterlab.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = argv[1:]
    spark, con = local_session(), duck(folder)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in qs:
        if names and not any(n in name for n in names):
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], sqls.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, msg, flush=True)
    print("failures:", bad, "of", len(qs))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
