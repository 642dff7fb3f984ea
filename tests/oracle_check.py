"""Run registered queries and their SQL side by side and compare the rows.

    python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal_rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)

    def value(x):
        if x is None:
            return "<null>"
        if isinstance(x, Decimal):
            x = float(x)
        if isinstance(x, float) and x.is_integer():
            return str(int(x))
        return str(x)

    return sorted(tuple(value(x) for x in row) for row in plain.itertuples(index=False))


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    frame = queries()[name](spark, sf_dir)
    left = frame.toPandas()
    spent = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return len(left) > 0, f"{len(left)} rows, no SQL, {spent:.1f}s"
    right = con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = normal_rows(left), normal_rows(right)
    if a == b:
        return True, f"{len(a)} rows, {spent:.1f}s"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return False, f"{len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}\n   {sorted(left.columns)}"


def main() -> int:
    from tidemark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), []
    for name in names:
        try:
            good, note = compare(spark, con, sf_dir, name)
        except Exception as problem:  # keep going: report every query
            good, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        print("ok  " if good else "FAIL", name, note, flush=True)
        bad += [] if good else [name]
    print(f"{len(names) - len(bad)} of {len(names)} agree", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
