"""Compare registered queries with their SQL twins run by DuckDB over the same files."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    if type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, folder: str) -> tuple[bool, str]:
    df = query(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} / {want_cols}"
    if len(got) != len(want):
        only = [r for r in want if r not in set(got)][:2], [r for r in got if r not in set(want)][:2]
        return False, f"rows {len(got)} / {len(want)} missing {only[0]} extra {only[1]}"
    if got == want:
        return True, f"{len(got)} rows"
    extra, lacking = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return False, f"{len(extra)} of {len(got)} rows differ: got {extra[:1]} want {lacking[:1]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pagewright import session

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = session.build(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, fn, oracles[name], folder)
            else:
                ok, note = True, f"{fn(spark, folder).count()} rows, no twin"
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, f"{time.time() - started:.1f}s", note[:900], flush=True)
    print("failures:", bad)
