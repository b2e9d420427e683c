"""Run every query on Spark and its SQL on DuckDB and compare the rows.

usage: python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from ldpspark.session import local_session  # noqa: E402
from workload import load  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    out = [tuple(plain(r[n]) for n in order) for r in rows]
    return [columns[n] for n in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def types_of(columns, rows):
    kinds = {}
    for r in rows:
        for c, v in zip(columns, r):
            if v is not None:
                kinds.setdefault(c, set()).add(type(v).__name__)
    return kinds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("8", "check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    registry = load()
    bad = 0
    for name in args.names or list(registry.queries):
        start = time.time()
        try:
            df = registry.queries[name](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in registry.oracle:
                print(f"rows   {name:26s} {len(got):8d} rows  spark {took:6.2f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(registry.oracle[name])
            want_cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - start
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR  {name:26s} {str(error)[:1500]}", flush=True)
            continue
        cols_a, a = rows_of(df.columns, got)
        cols_b, b = rows_of(want_cols, want)
        kinds_a, kinds_b = types_of(cols_a, a), types_of(cols_b, b)
        same = cols_a == cols_b and a == b and kinds_a == kinds_b
        state = "ok    " if same else "DIFF  "
        print(f"{state} {name:26s} {len(a):8d} rows  spark {took:6.2f}s  sql {sql_took:6.2f}s", flush=True)
        if not same:
            bad += 1
            if cols_a != cols_b:
                print("   columns", cols_a, cols_b)
            elif kinds_a != kinds_b:
                print("   types", {c: (kinds_a.get(c), kinds_b.get(c)) for c in cols_a if kinds_a.get(c) != kinds_b.get(c)})
            else:
                differing = [(x, y) for x, y in zip(a, b) if x != y]
                print("   rows", len(a), len(b), "differing", len(differing), cols_a)
                for x, y in differing[:3]:
                    print("    spark", x, "\n    sql  ", y)
    print("failed" if bad else "all equal", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
