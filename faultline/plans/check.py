"""Compare registered Spark queries with their DuckDB oracle SQL.

``python -m faultline.plans.check [sf_dir] [name ...]`` prints one line per
query.  Values are normalised (floats rounded, timestamps as text, arrays as
tuples) and compared as order-insensitive multisets over columns sorted by
name - the same contract the driver's correctness gate applies.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def duck_connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(norm(r[i]) for i in order) for r in data]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    scols, srows = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    dcols, drows = duck_rows(con, sql)
    ok = scols == dcols and Counter(srows) == Counter(drows)
    out = {"name": name, "ok": ok, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2)}
    if not ok:
        if scols != dcols:
            out["cols"] = (scols, dcols)
        else:
            a, b = Counter(srows), Counter(drows)
            out["only_spark"] = list((a - b).elements())[:3]
            out["only_oracle"] = list((b - a).elements())[:3]
    return out


def main(argv):
    from faultline.plans.registry import ORACLE, QUERIES, load_all
    from faultline.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    load_all()
    spark = get_session()
    con = duck_connect(sf_dir)
    bad = 0
    for name in names or sorted(QUERIES):
        try:
            r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if r["ok"] is False:
            bad += 1
        print(r, flush=True)
    print(f"done: {len(names or QUERIES)} queries, {bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
