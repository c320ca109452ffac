"""Compare registered queries with their SQL in DuckDB: python -m tests.verify [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback


def canon(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() and abs(v) < 2**53 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, registry, name, sf_dir):
    """(verdict, detail, spark rows, spark seconds)"""
    start = time.time()
    df = registry.queries[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in registry.sql:
        return "rows", "", len(got), took
    cur = con.execute(registry.sql[name])
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", f"{sorted(df.columns)} / {sorted(names)}", len(got), took
    if len(got) != len(want):
        return "COUNT", f"{len(got)} / {len(want)}", len(got), took
    if got != want:
        bad = next((g, w) for g, w in zip(got, want) if g != w)
        n = sum(g != w for g, w in zip(got, want))
        return "VALUES", f"{n} differ, first {bad[0]}  /  {bad[1]}", len(got), took
    return "ok", "", len(got), took


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tallyforge.registry import load
    from tallyforge.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    registry = load()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in registry.queries:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            verdict, detail, n, took = compare(spark, con, registry, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            verdict, detail, n, took = "ERROR", str(e).split("JVM stacktrace")[0][:900], 0, 0
            if os.environ.get("VERIFY_TRACE"):
                traceback.print_exc()
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:8}{name:40}{n:8} rows {took:6.2f}s  {detail}"[:1200], flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
