"""Run registered queries against their reference SQL in DuckDB: ``python -m workload.check [sf] [name ...]``."""

from __future__ import annotations

import collections
import datetime
import decimal
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def normal(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if value != value:
            return "NaN"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(normal(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(normal(row[i]) for i in order) for row in rows)


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def compare(spark, connection, sf_dir: str, name: str, query, sql: str | None):
    """(ok, message) for one query."""
    start = time.time()
    frame = query(spark, sf_dir)
    got = [tuple(row) for row in frame.collect()]
    spark_seconds = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {spark_seconds:.1f}s"
    start = time.time()
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    duck_seconds = time.time() - start
    timing = f"{spark_seconds:.1f}s / {duck_seconds:.1f}s"
    if sorted(columns) != sorted(frame.columns):
        return False, f"{name}: columns {sorted(frame.columns)} != {sorted(columns)}"
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    if a != b:
        sample = [sorted(map(str, (x - y).elements()))[:3] for x, y in ((a, b), (b, a))]
        wrong = sum((a - b).values())
        return False, f"{name}: {len(got)} vs {len(want)} rows, {wrong} differ {sorted(columns)}\n   {sample[0]}\n   {sample[1]} {timing}"
    return True, f"{name}: {len(got)} rows equal, {timing}"


def main() -> None:
    from bitcurve.session import local_session
    from workload import load

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    queries, oracles = load()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    sf_dir = f"/root/testdata/sf{sf}"
    if os.environ.get("PLAIN_SESSION"):  # Spark's defaults, to see what needs no settings
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "UTC")
        spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    failed = []
    for name in names:
        try:
            ok, message = compare(spark, connection, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on to the next query
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        if not ok:
            failed.append(name)
        print("ok  " if ok else "FAIL", message, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} pass; failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
