"""Run registered queries and their SQL twins side by side.

python tools/check.py [--sf DIR] [--plans] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from tallyloom.plans import load_all
from tallyloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (a != a and b != b)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def key(row):
    return tuple((x is None, str(type(x)), f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cpus", default="8")
    parser.add_argument("--plans", action="store_true")
    args = parser.parse_args()
    spark = local_session(args.cpus)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = q.build(spark, args.sf)
            if args.plans:
                df.explain("formatted")
            columns = sorted(df.columns)
            rows = [plain(tuple(r[c] for c in columns)) for r in df.collect()]
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(rows)} rows {took:.2f}s {rows[:1]}"[:200], flush=True)
            continue
        try:
            start = time.time()
            cursor = con.execute(q.sql)
            names = [d[0] for d in cursor.description]
            order = [names.index(c) for c in columns] if sorted(names) == columns else None
            other = [plain(tuple(r[k] for k in order)) for r in cursor.fetchall()] if order else None
        except Exception as error:
            bad += 1
            print(f"SQLFAIL {name}: {str(error)[:1200]}", flush=True)
            continue
        sql_took = time.time() - start
        if other is None:
            bad += 1
            print(f"COLUMNS {name}: {columns} vs {sorted(names)}", flush=True)
            continue
        a, b = sorted(rows, key=key), sorted(other, key=key)
        types = [type(x).__name__ for x in (a[0] if a else ())], [type(x).__name__ for x in (b[0] if b else ())]
        if a == b:
            note = "" if types[0] == types[1] else f" TYPES {types}"
            print(f"ok   {name}: {len(a)} rows {took:.2f}s (sql {sql_took:.2f}s){note}{' EMPTY' if not a else ''}", flush=True)
            continue
        bad += 1
        pairs = [(x, y) for x, y in zip(a, b) if not close(x, y)]
        inexact = [(x, y) for x, y in zip(a, b) if x != y]
        print(
            f"DIFF {name}: {len(a)} vs {len(b)} rows, {len(pairs)} differ, {len(inexact)} inexact {columns}\n"
            f"   {(pairs or inexact)[:3]}",
            flush=True,
        )
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
