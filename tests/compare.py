"""Runs registered queries in Spark and in DuckDB and compares the rows.

    python -m tests.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(decimal.Decimal(repr(value)).normalize(), "f")
    if isinstance(value, int):
        return str(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(_plain(row[i])) for i in order) for row in rows)


def compare(spark, connection, sf_dir, function, sql):
    frame = function(spark, sf_dir)
    left = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(sql)
    right = canonical([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return False, f"columns differ: {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return False, f"rows differ: {len(left[1])} / {len(right[1])}"
    if left[1] != right[1]:
        pair = next((a, b) for a, b in zip(left[1], right[1]) if a != b)
        return False, f"values differ:\n   {pair[0]}\n   {pair[1]}"
    return True, len(left[1])


def main() -> None:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, connection = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name, function in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                good, note = compare(spark, connection, sf_dir, function, oracles[name])
            else:
                good, note = True, f"{function(spark, sf_dir).count()} (rows only)"
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        if not good:
            failed.append(name)
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
