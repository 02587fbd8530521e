"""Runs registered queries next to their DuckDB twins.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


def compare(df, sql, connection) -> list[str]:
    """Differences between a Spark result and its twin; empty if there are none."""
    twin = connection.execute(sql)
    names = [d[0] for d in twin.description]
    types = {d[0]: str(d[1]) for d in twin.description}
    expected = rows_of(names, twin.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(types[name], types[name]) != kind:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, e.g. {str(wrong[0][0])[:300]} != {str(wrong[0][1])[:300]}")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name, function in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = contract.oracle_sql().get(name)
            df = function(spark, folder)
            if sql is None:
                problems, shown = [], f"{len(df.collect())} rows, no twin"
            else:
                problems, shown = compare(df, sql, connection), "equal"
        except Exception as error:  # noqa: BLE001
            problems, shown = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name:32s}{time.time() - start:7.1f}s  {'; '.join(problems) or shown}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
