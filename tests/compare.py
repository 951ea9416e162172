"""Runs queries beside their oracle SQL and says where rows differ: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty where both give the same rows."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    ours, theirs = set(got), set(want)
    only, other = [r for r in got if r not in theirs][:3], [r for r in want if r not in ours][:3]
    return f"{len(got)} and {len(want)} rows; only in Spark {only}; only in SQL {other}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            said = differences(queries[name](spark, sf), con, sql[name]) or "ok"
        except Exception:
            said = "ERROR " + "\n".join(x for x in traceback.format_exc().splitlines() if not x.lstrip().startswith("at "))[-700:]
        print(f"{name}: {time.time() - began:.1f} s: {said[:900]}", flush=True)
