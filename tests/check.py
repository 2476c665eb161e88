"""Run registered queries against their SQL. Usage: python -m tests.check [sf] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return repr(round(value, 9))
        if isinstance(value, pd.Timestamp):
            value = value.to_pydatetime()
        return str(value)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, connection, sf_dir: str, name: str, fn, sql: str):
    """Problems found, as text; empty when both sides agree."""
    frame = fn(spark, sf_dir)
    ours = canonical([tuple(r) for r in frame.collect()], frame.columns)
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    theirs = canonical(result.fetchall(), columns)
    problems = []
    if sorted(columns) != sorted(frame.columns):
        return [f"columns differ: {sorted(frame.columns)} / {sorted(columns)}"]
    spark_names = {"bigint": "BIGINT", "int": "INTEGER", "date": "DATE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP"}
    for column, kind in frame.dtypes:
        want = spark_names.get(kind, kind.upper())
        if types[column].replace(" ", "") != want:
            problems.append(f"type of {column}: {want} / {types[column]}")
    if len(ours) != len(theirs):
        problems.append(f"rows: {len(ours)} / {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]} (columns {sorted(columns)})")
    return problems


def main(arguments: list[str]) -> int:
    from tideline.plans import all_oracles, all_queries
    from tideline.session import local_session

    sf = arguments[0] if arguments else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, connection = local_session(8), oracle(sf_dir)
    oracles, failed = all_oracles(), 0
    for name, fn in all_queries().items():
        if arguments[1:] and name not in arguments[1:]:
            continue
        started = time.time()
        if name not in oracles:
            print(f"rows  {name}: {fn(spark, sf_dir).count()} ({time.time() - started:.1f}s)")
            continue
        try:
            problems = compare(spark, connection, sf_dir, name, fn, oracles[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [str(error)[:1500]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok'}  {name} ({time.time() - started:.1f}s)",
              *problems, sep="\n      " if problems else " ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
