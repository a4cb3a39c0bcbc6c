"""Run registered queries next to their SQL twins and compare every value.

    python tools/check_queries.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if hasattr(v, "as_tuple"):
        return norm(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def kinds(names, rows):
    """Kind of value per column: whole, float, text..."""
    out = {}
    for i, name in enumerate(names):
        out[name] = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return out


def compare(df, con, sql) -> str | None:
    """None if equal, else what differs."""
    left = df.collect()
    names, mine = rows_of(df.columns, left)
    cur = con.execute(sql)
    columns, right = [d[0] for d in cur.description], cur.fetchall()
    other, theirs = rows_of(columns, right)
    a, b = kinds(df.columns, left), kinds(columns, right)
    if mismatch := [f"{n}: {a[n]} vs {b[n]}" for n in a if n in b and a[n] and b[n] and a[n] != b[n]]:
        return f"types {mismatch}"
    if names != other:
        return f"columns {names} vs {other}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    if mine != theirs:
        left, right = set(mine), set(theirs)
        return f"{len(left - right)} rows differ, e.g. {list(left - right)[:2]} vs {list(right - left)[:2]}"
    return None


def main() -> int:
    from mlframe.plans import ORACLES, QUERIES
    from mlframe.session import get_session, release_scratch

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--sql-only", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(args.sf), 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        if args.sql_only and name not in ORACLES:
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            if name in ORACLES:
                diff = compare(df, con, ORACLES[name])
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                rows = df.collect()
                state = f"rows {len(rows)} {rows[:2]}"
                if not rows:
                    state = "DIFF no rows"
        except Exception as e:  # noqa: BLE001
            state = f"FAIL {type(e).__name__} {str(e)[:1500]}"
        spark.catalog.clearCache()
        release_scratch(spark)
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.time() - start:6.2f}s {state[:1700]}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
