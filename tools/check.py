"""Run registered queries in Spark and their check SQL in DuckDB and compare the rows.

    python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sightline.plans import CHECKS, QUERIES  # noqa: E402
from sightline.plans.fixtures import TABLES  # noqa: E402
from sightline.session import local_session  # noqa: E402


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if pd.isna(v):
            return "∅"
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def compare(spark, con, name: str, sf: str) -> tuple[str, int, float]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    left = df.toPandas()
    took = time.time() - start
    if name not in CHECKS:
        return "rows only", len(left), took
    relation = con.sql(CHECKS[name])
    right = relation.df()
    if sorted(left.columns) != sorted(right.columns):
        return f"COLUMNS {sorted(left.columns)} != {sorted(right.columns)}", len(left), took
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    odd = [
        f"{n}:{spark_types[n]}/{t}"
        for n, t in zip(relation.columns, relation.types)
        if same.get(spark_types[n]) != str(t)
    ]
    a, b = rows_of(left), rows_of(right)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"ROWS {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"[:1500], len(left), took
    return f"TYPES {odd}" if odd else "ok", len(left), took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name in args.names or QUERIES:
        try:
            verdict, n, took = compare(spark, con, name, args.sf)
        except Exception as exc:  # report and go on with the next query
            verdict, n, took = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", 0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:26s} {n:7d} rows {took:6.2f}s  {verdict}", flush=True)
    print("failing:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
