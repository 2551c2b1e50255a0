"""Local stand-in for the driver's correctness gate.

Runs every registered query on Spark and its oracle SQL on DuckDB over the same
parquet tables, then compares column names, row counts and the multiset of rows
(floats at 6 decimals).  Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # pandas renders a null of a numeric column as NaN
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6) + 0.0
        return int(r) if r.is_integer() else r
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
        return _norm(v) if isinstance(v, float) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (isinstance(x, float) and math.isnan(x) and False) else x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in sorted(q):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q[name](spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name]) if verbose else None
            continue
        ts = time.time() - t0
        if name not in o:
            results[name] = f"rows-only ({len(spdf)} rows)"
            print(f"{name}: {results[name]} {ts:.1f}s") if verbose else None
            continue
        try:
            dpdf = con.execute(o[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name]) if verbose else None
            continue
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(dpdf)
        if sc != dc:
            status = f"COLUMNS differ spark={sc} duck={dc}"
        elif len(sr) != len(dr):
            status = f"ROWCOUNT spark={len(sr)} duck={len(dr)}"
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
            status = f"VALUES differ e.g. {diff}"
        else:
            status = f"OK ({len(sr)} rows)"
        results[name] = status
        if verbose:
            print(f"{name}: {status} {ts:.1f}s")
    return results


if __name__ == "__main__":
    from talkframe.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    res = compare(spark, sf, set(sys.argv[2:]) or None)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    sys.exit(1 if bad else 0)
