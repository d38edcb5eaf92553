"""Run registered queries next to their reference SQL and compare.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SPARK_SECONDS: dict[str, float] = {}


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return f"f{value!r}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, connection, name, function, sql, sf_dir):
    """None when equal, otherwise a short description."""
    started = time.time()
    frame = function(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    SPARK_SECONDS[name] = time.time() - started
    if sql is None:
        return None if got else "no rows"
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    for left, right in zip(a, b):
        if left != right:
            return f"{sorted(columns)}: {left} != {right}"
    return None


def main() -> int:
    from sitesift.plans.catalog import ORACLES, QUERIES
    from sitesift.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "oracle-check", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, connection, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - started:6.2f}s (spark {SPARK_SECONDS.get(name, 0):6.2f}s) {name} {problem or ''}", flush=True)
        failures += problem is not None
    print(f"{len(names)} queries, {failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
