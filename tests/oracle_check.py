"""Run registered queries beside their SQL and compare every value.

    python tests/oracle_check.py [--sf DIR] [name part ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


KIND = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def compare(df, con, sql: str) -> list[str]:
    problems = []
    rel = con.sql(sql)
    names, kinds = rel.columns, [str(t) for t in rel.types]
    order = sorted(names)
    if sorted(df.columns) != order:
        return [f"columns {sorted(df.columns)} != {order}"]
    types = dict(df.dtypes)
    for n, k in zip(names, kinds):
        if KIND.get(types[n], types[n]) != k and not types[n].startswith(("array", "struct", "map")):
            problems.append(f"type {n}: {types[n]} / {k}")
    want_rows = [tuple(plain(v) for v in r) for r in rel.project(
        ", ".join(f'"{n}"' for n in order)).fetchall()]
    got_rows = [tuple(plain(r[n]) for n in order) for r in df.collect()]
    key = lambda r: tuple(str(v) for v in r)
    want_rows.sort(key=key)
    got_rows.sort(key=key)
    if len(got_rows) != len(want_rows):
        problems.append(f"rows {len(got_rows)} != {len(want_rows)}")
    bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {order}, first: {bad[0][0]} / {bad[0][1]}")
    if not got_rows:
        problems.append("no rows")
    return problems


def main(args: list[str]) -> int:
    from barframe.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t0:.1f}s"
              + ("" if name in oracles else " (rows only)"), flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
