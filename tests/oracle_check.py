"""Run queries on Spark and their oracle SQL on DuckDB and compare like the driver:
row count, column names, and an order-insensitive hash of the rounded values."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, name, build, sql, sf_dir, con, verbose=True):
    t = time.time()
    sdf = build(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(ts, 2))
    t = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    td = time.time() - t
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
    res = dict(name=name, ok=ok, rows=len(srows), duck_rows=len(drows), spark_s=round(ts, 2), duck_s=round(td, 2))
    if not ok and verbose:
        res["cols"] = (sorted(scols), sorted(dcols))
        only_s = sorted(set(ls) - set(ld))[:5]
        only_d = sorted(set(ld) - set(ls))[:5]
        res["only_spark"], res["only_duck"] = only_s, only_d
    return res


def main(argv):
    from mnemo.session import build_session
    import __spark_entry__ as E
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = argv or list(E.queries())
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], sqls.get(n), sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=n, ok=False, error=repr(e)[:800])
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
