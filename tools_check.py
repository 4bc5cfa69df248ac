"""Local correctness check: each registered Spark query against its DuckDB SQL.

Usage: python tools_check.py [sf_dir] [name ...]
"""

import math
import sys
import time

import duckdb

from tillcast.plans.registry import load_all
from tillcast.session import get_spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    qs, sqls = load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            cols = sorted(sdf.columns)
            srows = [tuple(norm(r[c]) for c in cols) for r in sdf.collect()]
        except Exception as e:  # noqa
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows_raw = res.fetchall()
        except Exception as e:  # noqa
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(dcols) != cols:
            print(f"FAIL {name}: columns spark={cols} duck={sorted(dcols)}")
            bad += 1
            continue
        idx = [dcols.index(c) for c in cols]
        drows = [tuple(norm(r[i]) for i in idx) for r in drows_raw]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        a, b = sorted(srows, key=key), sorted(drows, key=key)
        if a == b:
            print(f"OK   {name}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)} first diffs={diff} cols={cols}")
    print("bad", bad)


if __name__ == "__main__":
    main()
