"""Run registered queries against their DuckDB oracles (the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from kbspark.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, oracles = E.queries(), E.oracle_sql()
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {str(exc)[:400]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"{name}: rows-only {len(srows)} rows, spark {ts:.1f}s", flush=True)
            continue
        t1 = time.time()
        try:
            res = con.execute(oracles[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"{name}: ORACLE ERROR {str(exc)[:400]}", flush=True)
            continue
        to = time.time() - t1
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        print(f"{name}: {'MATCH' if ok else 'MISMATCH'} rows {len(srows)}/{len(orows)} "
              f"spark {ts:.1f}s duckdb {to:.1f}s", flush=True)
        if not ok:
            if sorted(scols) != sorted(ocols):
                print("   cols", sorted(scols), sorted(ocols))
            a, b = set(ls), set(lo)
            print("   spark-only:", list(a - b)[:3])
            print("   oracle-only:", list(b - a)[:3])


if __name__ == "__main__":
    main()
