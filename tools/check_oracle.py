"""Run registered Spark queries and their DuckDB oracle side by side (local check).

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pulse.plans.catalog import load_all  # noqa: E402
from pulse.session import local_session  # noqa: E402
from pulse.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v) if v is not None else "NULL"


def rows_key(rows):
    return sorted(tuple(norm(x) for x in r) for r in rows)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    reg = load_all()
    if os.environ.get("PLAIN_SESSION"):
        # a session as the driver builds it: none of pulse's settings
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, e in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = e.run(spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.oracle is None:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(e.oracle)
            ocols = [x[0] for x in res.description]
            orows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(ex)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {cols} vs {ocols}")
            bad += 1
            continue
        order = [ocols.index(c) for c in cols]
        orows = [tuple(r[i] for i in order) for r in orows]
        a, b = rows_key(srows), rows_key(orows)
        if a != b:
            bad += 1
            diff_a = [r for r in a if r not in b][:3]
            diff_b = [r for r in b if r not in a][:3]
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}; spark-only {diff_a}; oracle-only {diff_b}")
        else:
            print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
