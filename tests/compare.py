"""Run a registered query on Spark and its SQL on DuckDB and compare rows, columns and values.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def normal(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


# Spark type -> DuckDB type, where the names differ.
TYPES = {"int": "INTEGER", "string": "VARCHAR"}


def type_differences(df, result) -> list[str]:
    theirs = {d[0]: str(d[1]) for d in result.description}
    found = []
    for name, kind in df.dtypes:
        expected = TYPES.get(kind, kind.upper())
        if theirs[name] != expected:
            found.append(f"{name}: {kind} / {theirs[name]}")
    return found


def compare(spark, con, query, sql: str, folder: str) -> str:
    """Empty text if both agree, else what differs."""
    df = query(spark, folder)
    left_columns, left = normal(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right_columns, right = normal(names, result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if different := type_differences(df, result):
        return f"types {different}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(pairs)} rows differ, first {left_columns}: {pairs[0][0]} / {pairs[0][1]}"
    return "" if left else "both empty"


def main() -> None:
    from cohortspan.plans.registry import oracle_sql, queries
    from cohortspan.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    checks = oracle_sql()
    for name, query in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            if name in checks:
                outcome = compare(spark, con, query, checks[name], folder) or "ok"
            else:
                outcome = f"rows only: {query(spark, folder).count()}"
        except Exception as error:
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {outcome} ({time.time() - start:.1f}s)", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
