"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Mimics the driver: same column names, same row count, same multiset of rows.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from rageval.session import get_session  # noqa: E402
from rageval.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = get_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in orc:
            print(f"{k:28s} rows={len(srows):6d} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(orc[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} DUCKDB ERROR {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        ok = ok_cols and a == b
        bad += not ok
        print(f"{k:28s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)} {ts:.1f}s")
        if not ok:
            if not ok_cols:
                print("   cols", sorted(scols), sorted(dcols))
            sa, sb = set(a), set(b)
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck :", list(sb - sa)[:3])
    print("FAILURES", bad)


if __name__ == "__main__":
    main()
