"""Compare registered queries with their SQL: python tests/check.py [sf] [name ...]."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None if value is None else "nan"
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(row[i]) for i in order) for row in rows)


def compare(spark, con, query, oracle, sf):
    started = time.time()
    df = query(spark, sf)
    got = df.collect()
    spent = time.time() - started
    if oracle is None:
        return spent, len(got), "rows only"
    want = con.execute(oracle)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return spent, len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    if a == b:
        return spent, len(got), "ok"
    return spent, len(got), f"DIFFERENT {len(got)} vs {len(expected)} rows; only spark {list((a - b).items())[:2]}; only sql {list((b - a).items())[:2]}"


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from meterlake.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            spent, n, verdict = compare(spark, con, query, oracles.get(name), sf)
        except Exception as error:
            spent, n, verdict = 0.0, -1, f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:36s} {spent:6.2f}s {n:8d} {verdict}", flush=True)
    print("failed:", bad)
