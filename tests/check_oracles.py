"""Run every query against its DuckDB statement: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def _bag(columns: list[str], rows) -> dict:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    bag: dict = {}
    for r in rows:
        k = tuple(_norm(r[i]) for i in order)
        bag[k] = bag.get(k, 0) + 1
    return bag


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = _bag(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return ""
    extra = [k for k in got if got[k] != want.get(k)]
    lack = [k for k in want if want[k] != got.get(k)]
    return f"rows {sum(got.values())} vs {sum(want.values())}; only here {extra[:3]}; only there {lack[:3]}"


def main() -> int:
    import __spark_entry__ as entry
    from bundlewise.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, sql[name]) if name in sql else f"no sql; {query(spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:<26} {time.time() - t0:6.2f}s {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
