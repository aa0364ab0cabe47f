"""Run registered Spark queries against their DuckDB oracle SQL and compare row count, column names and
order-insensitive values. Usable from pytest and as a CLI: python tests/oracle_harness.py [keys...]."""
from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0.0:                 # a value hash may tell -0.0 from 0.0: so do we
            return ("zero", math.copysign(1.0, v))
        return round(v, digits) if digits is not None else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    return v


def _rows(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, key: str, sf_dir: str, con=None, digits: int | None = None) -> dict:
    import __spark_entry__ as E

    q, sql = E.queries()[key], E.oracle_sql().get(key)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"key": key, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["oracle"] = "none"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res.update(oracle_rows=len(drows), duck_sec=round(time.time() - t1, 2))
    res["names_ok"] = sorted(scols) == sorted(dcols)
    if not res["names_ok"]:
        res["names"] = (sorted(set(scols) - set(dcols)), sorted(set(dcols) - set(scols)))
        return res
    a, b = _rows(scols, srows, digits), _rows(dcols, drows, digits)
    res["values_ok"] = a == b
    if not res["values_ok"]:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["first_diff"] = bad
        names = sorted(scols)
        if bad:
            x, y = bad[0]
            res["diff_cols"] = [names[i] for i in range(len(names)) if x[i] != y[i]]
    return res


if __name__ == "__main__":
    import __spark_entry__ as E
    from soilcast.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    keys = sys.argv[1:] or sorted(E.queries())
    con = duck(sf)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "error": repr(e)[:800]}
        ok = r.get("values_ok") or r.get("oracle") == "none"
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
