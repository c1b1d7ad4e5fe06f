"""Run registered queries on Spark and their SQL twins on DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares column names, row counts and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    import numpy as np
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6) + 0.0
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    spdf = fn(spark, sf).toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(spdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    dpdf = con.execute(sql).df()
    res["duck_rows"] = len(dpdf)
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    if sc != dc:
        res["status"] = f"COLUMNS {sc} vs {dc}"
    elif len(sr) != len(dr):
        res["status"] = "ROWCOUNT"
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["status"] = f"VALUES {bad}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    import duckdb
    from arbora.plans.catalog import ORACLE, QUERIES
    from arbora.session import local_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    failed = 0
    for n in names:
        try:
            r = compare(spark, con, n, QUERIES[n], ORACLE.get(n), sf)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            failed += 1
        print(r, flush=True)
    print(f"failed={failed} of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
