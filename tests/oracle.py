"""Run registered queries against their SQL in DuckDB: ``python tests/oracle.py <sf_dir> [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(kind(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return took, len(got), "rows only"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a[0] != b[0]:
        return took, len(got), f"COLUMNS {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return took, len(got), f"ROWS {len(a[1])} / {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if repr(x) != repr(y)]
    if bad:
        x, y = bad[0]
        diff = [(n, i, j) for n, i, j in zip(a[0], x, y) if repr(i) != repr(j)]
        return took, len(got), f"VALUES {len(bad)} differ, first: {diff[:4]} in {x}"[:900]
    return took, len(got), "ok"


def main():
    import __spark_entry__ as entry

    from pulseloom.session import local_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session("oracle", cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = [k for k in sqls if k not in queries]
    if bad:
        print("SQL without query:", bad)
    failed = 0
    for name, query in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            took, n, verdict = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as exc:  # keep going: one report for all queries
            took, n, verdict = 0.0, -1, f"ERROR {type(exc).__name__} {str(exc)[:700]}"
        if verdict not in ("ok", "rows only"):
            failed += 1
        print(f"{name:44s} {took:6.2f}s {n:8d}  {verdict}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
