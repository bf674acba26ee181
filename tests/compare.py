"""Runs registered queries on Spark and DuckDB and compares the rows.

    python tests/compare.py [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duckdb_on(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(str, r))
    )


def difference(spark_df, connection, sql) -> str | None:
    """None if both give the same rows, else the first thing that differs."""
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    right = rows_of([c[0] for c in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"{a} / {b}"
    return None


def main(sf="0.01", *names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_on(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    bad = 0
    for name in names or queries:
        begin = time.monotonic()
        frame = queries[name](spark, folder)
        if name not in oracles:
            print(f"{name:32} rows {frame.count()}  {time.monotonic() - begin:6.1f}s", flush=True)
            continue
        rows = frame.collect()
        middle = time.monotonic()
        try:
            wrong = difference(frame, connection, oracles[name])
        except Exception as error:  # show the statement's own message
            wrong = str(error)[:600]
        bad += wrong is not None
        print(
            f"{name:32} {'ok' if wrong is None else 'DIFFERS ' + wrong}  {len(rows)} rows "
            f"spark {middle - begin:6.1f}s both {time.monotonic() - middle:6.1f}s",
            flush=True,
        )
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
