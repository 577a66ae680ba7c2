"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from ledgerlake.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402

from ledgerlake.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    load_all()
    import os
    if os.environ.get("DRIVER_LIKE"):
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
            .config("spark.driver.memory", "16g").getOrCreate()
    else:
        from ledgerlake.session import local_session
        spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        sql = ORACLES.get(name)
        if sql is None:
            print(f"rows {name}: {len(srows)} rows, {dt:.1f}s (no oracle)")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)} first diffs={diff}")
            bad += 1
        else:
            print(f"ok   {name}: {len(a)} rows {dt:.1f}s")
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
