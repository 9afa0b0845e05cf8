"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tests/check_oracle.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive hash of the values
(columns sorted by name, doubles rounded), like the driver's correctness gate.
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as entry  # noqa: E402
from spruce.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            traceback.print_exc(limit=3)
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sql:
            print(f"rows {name}: {len(srows)} rows ({dt:.1f}s), no oracle")
            continue
        try:
            res = con.execute(sql[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={scols} duck={dcols}")
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                problems.append(f"values differ e.g. {diff}")
        if problems:
            bad += 1
            print(f"FAIL {name} ({dt:.1f}s): " + "; ".join(problems))
        else:
            print(f"ok   {name}: {len(srows)} rows ({dt:.1f}s)")
    print(f"{bad} failing of {len(names or qs)}")


if __name__ == "__main__":
    main()
