"""Run registered queries beside their SQL: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = entry_module.queries()[name](spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got)}"
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return not bad, f"{len(got)} rows" if not bad else f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols} {bad[:2]}"


def main() -> int:
    from pulseframe.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry_module.queries())
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            ok, text = compare(spark, con, name, folder)
        except Exception as error:
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.1f}s {name}: {text}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
