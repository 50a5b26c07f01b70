"""Run registered queries in Spark and their SQL oracles in DuckDB and compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive multiset of rows
(columns sorted by name). Prints one line per query and a summary.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from sitegrove.plans.all import REGISTRY  # noqa: E402
from sitegrove.session import build_session  # noqa: E402
from sitegrove.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(norm(x) for x in rec)] += 1
    return cols, out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(REGISTRY)
    if len(names) == 1 and names[0].startswith("q_"):
        names = sorted(k for k, q in REGISTRY.items() if q.build.__module__.endswith(names[0]))
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = rows_only = 0
    for name in names:
        q = REGISTRY[name]
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            pdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {name}: {len(pdf)} rows ({ts:.1f}s) [no oracle]")
            rows_only += 1
            continue
        try:
            odf = con.execute(q.sql).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sd = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        od = dict(zip(odf.columns, [str(t) for t in con.execute(f"DESCRIBE {q.sql}").fetchall()]))
        c1, r1 = rows_of(pdf)
        c2, r2 = rows_of(odf)
        if c1 != c2:
            print(f"FAIL {name}: columns {c1} vs {c2}")
            bad += 1
        elif r1 != r2:
            d1 = list((r1 - r2).items())[:2]
            d2 = list((r2 - r1).items())[:2]
            print(f"FAIL {name}: rows {len(pdf)} vs {len(odf)}; spark-only {str(d1)[:700]} ; oracle-only {str(d2)[:700]}")
            bad += 1
        else:
            print(f"OK   {name}: {len(pdf)} rows ({ts:.1f}s)")
            if "-v" in os.environ.get("CHECK_FLAGS", ""):
                print("     spark", sd)
                print("     duck ", {k: v.split(",")[1].strip(" '") for k, v in od.items()})
            ok += 1
    print(f"summary: ok={ok} fail={bad} rows_only={rows_only}")


if __name__ == "__main__":
    main()
