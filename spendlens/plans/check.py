"""Compare catalogue queries with their DuckDB SQL: row count, column names, values.

Usage: ``python -m spendlens.plans.check [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _canon(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, sf_dir: str, names=None, con=None) -> dict:
    from spendlens.plans.catalog import QUERIES
    from spendlens.plans.oracle import ORACLE

    con = con or duck(sf_dir)
    results = {}
    for name in names or list(QUERIES):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
            t1 = time.time()
            rel = con.execute(ORACLE[name])
            d_cols = [d[0] for d in rel.description]
            d_rows = rel.fetchall()
            ok_cols = sorted(s_cols) == sorted(d_cols)
            ok_n = len(s_rows) == len(d_rows)
            ok_v = ok_cols and ok_n and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
            res = {"cols": ok_cols, "rows": ok_n, "values": ok_v, "n": len(s_rows), "n_oracle": len(d_rows), "sec": round(t1 - t0, 2)}
            if not ok_v:
                res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
                if ok_cols and ok_n:
                    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
                    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                    res["diff"] = repr(diff)[:1500]
        except Exception as e:  # noqa: BLE001
            res = {"error": f"{type(e).__name__}: {str(e)[:1500]}"}
        results[name] = res
        print(name, res, flush=True)
    return results


if __name__ == "__main__":
    from spendlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    r = compare(spark, sf, names)
    bad = [k for k, v in r.items() if not v.get("values")]
    print("FAILED:", bad if bad else "none")
