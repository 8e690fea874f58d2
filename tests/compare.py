"""Run registered queries next to their SQL and compare every value."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return spent, len(got), None
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    problem = None
    if sorted(df.columns) != sorted(names):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
    elif got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        problem = f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return spent, len(got), problem


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from loamline.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            spent, rows, problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
            print(f"{name:28s} {spent:6.1f}s {rows:8d} {'ROWS' if name not in oracles else problem or 'ok'}"[:600], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} FAILED {str(e)[:500]}", flush=True)
