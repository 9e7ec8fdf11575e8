"""Compare registered queries with their SQL twins.

Run as ``python tests/oracle.py [--sf 0.001] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}" if not math.isinf(v) else str(v)
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), "rows only"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = [str(d[1]) for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = dict(zip(names, types))
    for f in df.schema.fields:
        a, b = f.dataType.simpleString(), kinds[f.name]
        isf = lambda x: x.lower() in ("double", "float")
        if isf(a) != isf(b) or ("decimal" in b.lower() or "hugeint" in b.lower()) and "decimal" not in a:
            return len(got), f"type of {f.name}: {a} vs {b}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return len(got), f"values differ: {len(got)} vs {len(want)} rows, e.g. {diff} cols {sorted(names)}"
    return len(got), "ok"


def main(argv):
    import __spark_entry__ as E
    from tapelab.session import local_session

    sf = "0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in argv or qs:
        t0 = time.time()
        try:
            n, msg = compare(spark, con, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            n, msg = -1, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += msg not in ("ok", "rows only")
        print(f"{name:34s} {n:7d} rows {time.time() - t0:6.2f}s {msg}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
