"""Runs registered queries and their SQL counterparts side by side.

usage: python tests/oracle_compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (Decimal, float)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return float(value)
    return value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"rows {len(got)} (no SQL) spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    t2 = time.time()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = normal(got_cols, got), normal(want_cols, want)
    if a == b:
        return True, f"rows {len(a)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    only_a, only_b = sorted(set(map(repr, a)) - set(map(repr, b)))[:3], sorted(set(map(repr, b)) - set(map(repr, a)))[:3]
    return False, f"rows {len(a)} vs {len(b)}\n   spark only {only_a}\n   sql only   {only_b}"


def main(argv: list[str]) -> int:
    from hostwarden.session import local_session

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    prefixes = tuple(argv[1:])
    spark, con = local_session(), connect(sf_dir)
    spark.conf.set("spark.sql.ui.showConsoleProgress", "false")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in queries:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print(("ok   " if ok else "FAIL "), name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
