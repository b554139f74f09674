"""Compare registered queries with their SQL on the given tables.

usage: python tools/check.py [sf] [name ...]
"""

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from strainshift.plans import catalog  # noqa: E402
from strainshift.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v) if not isinstance(v, dt.date) else v.isoformat()


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf, inspect=None):
    """Run a query and its SQL; ``inspect`` may look at the query's plan first."""
    start = time.time()
    df = catalog.QUERIES[name](spark, sf)
    if inspect:
        inspect(df)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in catalog.ORACLES:
        return f"rows {len(rows)}", took, 0.0, len(rows) > 0
    start = time.time()
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    left, right = table_of(df.columns, rows), table_of(names, want)
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", took, sql_took, False
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}", took, sql_took, False
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0]}", took, sql_took, False
    return f"rows {len(rows)}", took, sql_took, len(rows) > 0


def main():
    args = sys.argv[1:]
    sf = f"/root/testdata/sf{args[0] if args else '0.01'}"
    names = args[1:] or list(catalog.QUERIES)
    spark, con = local_session(), connect(sf)
    failed = []
    for name in names:
        try:
            text, took, sql_took, ok = compare(spark, con, name, sf)
        except Exception as error:
            text, took, sql_took, ok = f"{type(error).__name__}: {str(error)[:700]}", 0, 0, False
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s {sql_took:6.2f}s {text}", flush=True)
        failed += [] if ok else [name]
    print(len(names) - len(failed), "ok,", len(failed), "failed:", *failed)


if __name__ == "__main__":
    main()
