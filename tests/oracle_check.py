"""Run queries() against oracle_sql() the way the driver does: row count,
column names (sorted) and an order-insensitive multiset of rows.  Doubles are
compared exactly (ORACLE_ROUND=1 rounds them to 6 decimals instead).
Usage: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402,I001
from closurelens.session import local_session  # noqa: E402
from closurelens.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return (round(v, 6) if os.environ.get("ORACLE_ROUND", "0") == "1" else v) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir, sql):
    t0 = time.time()
    df = E.queries()[name](spark, sf_dir)
    rows = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    ts = time.time() - t0
    if sql is None:
        return f"{name:28s} ROWS-ONLY rows={len(rows)} spark={ts:.1f}s"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    orows = [tuple(norm(r[i]) for i in order) for r in data]
    ok_cols = sorted(df.columns) == sorted(cols)
    ok_n = len(rows) == len(orows)
    ok_v = Counter(map(repr, rows)) == Counter(map(repr, orows))
    status = "OK" if (ok_cols and ok_n and ok_v) else "FAIL"
    msg = f"{name:28s} {status} rows={len(rows)}/{len(orows)} spark={ts:.1f}s"
    if not ok_cols:
        msg += f"\n   cols spark={sorted(df.columns)}\n   cols sql  ={sorted(cols)}"
    elif not ok_v:
        a = Counter(map(repr, rows)) - Counter(map(repr, orows))
        b = Counter(map(repr, orows)) - Counter(map(repr, rows))
        msg += f"\n   cols={sorted(cols)}\n   spark-only={list(a)[:3]}\n   sql-only  ={list(b)[:3]}"
    return msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")] or list(E.queries())
    spark = local_session(8)
    con = duck(sf_dir)
    sqls = E.oracle_sql()
    bad = 0
    for n in names:
        try:
            m = compare(spark, con, n, sf_dir, sqls.get(n))
        except Exception as ex:  # report and continue
            m = f"{n:28s} ERROR {type(ex).__name__}: {str(ex)[:400]}"
        if "FAIL" in m or "ERROR" in m:
            bad += 1
        print(m, flush=True)
    print(f"done: {len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
