"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--plain-session", action="store_true", help="a default SparkSession, as a driver would build")
    args = ap.parse_args()
    import duckdb
    from postlake.session import get_spark
    from postlake.plans.catalog import ORACLE, QUERIES, load_all
    load_all()
    if args.plain_session:
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").appName("plain")
                 .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    keys = args.keys or sorted(QUERIES)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = QUERIES[k](spark, args.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            stypes = dict(sdf.dtypes)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in ORACLE:
            print(f"rows {k}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(ORACLE[k])
            dcols = [d[0] for d in cur.description]
            dtypes = {d[0]: str(d[1]) for d in cur.description}
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows)
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = ok and hs == hd
        print(f"{'OK  ' if ok else 'FAIL'} {k}: spark {len(srows)} duck {len(drows)} {ts:.1f}s "
              f"types spark={[stypes[c] for c in sorted(scols)]} duck={[dtypes.get(c) for c in sorted(dcols)]}")
        if not ok:
            bad += 1
            if sorted(scols) != sorted(dcols):
                print("   cols", sorted(scols), sorted(dcols))
            else:
                sd, dd = set(ls), set(ld)
                print("   spark-only", list(sd - dd)[:3])
                print("   duck-only ", list(dd - sd)[:3])
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main()
