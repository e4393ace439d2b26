"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    from hostlens.registry import all_queries
    con = duck(sf_dir)
    results = {}
    for name, q in sorted(all_queries().items()):
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK-ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:32s} SPARK-ERROR {results[name][1]}", flush=True)
            continue
        ts = time.time() - t0
        if q.sql is None:
            results[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name:32s} rows-only n={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL-ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:32s} SQL-ERROR {results[name][1]}", flush=True)
            continue
        status = "OK"
        detail = ""
        if sorted(scols) != sorted(dcols):
            status, detail = "SCHEMA", f"spark={scols} sql={dcols}"
        elif len(srows) != len(drows):
            status, detail = "ROWS", f"spark={len(srows)} sql={len(drows)}"
        else:
            a, b = _rows(scols, srows), _rows(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                status, detail = "VALUES", f"{sorted(scols)} {diff}"
        results[name] = (status, detail)
        if verbose:
            print(f"{name:32s} {status} n={len(srows)} {ts:.1f}s {detail[:600]}", flush=True)
    return results


if __name__ == "__main__":
    from hostlens.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    print("SUMMARY", len(res), "queries,", len(bad), "not ok:", sorted(bad))
