"""Run queries beside their SQL and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from checks.oracle import QUERIES
from checks.queries import REGISTRY


def plain(value: object) -> object:
    """A value both engines print alike; numbers keep their full precision."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def bag(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def compare(spark, connection: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None if the results agree, else what differs."""
    frame = REGISTRY[name](spark, folder)
    columns, found = bag(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(QUERIES[name])
    wanted_columns, wanted = bag([c[0] for c in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}"
    if found != wanted:
        extra, absent = found - wanted, wanted - found
        return f"{sum(found.values())} rows, {sum(wanted.values())} wanted; extra {list(extra)[:2]}; absent {list(absent)[:2]}"
    return None


def main(folder: str, names: list[str]) -> int:
    from sensorloom.settings import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names or list(REGISTRY):
        start = time.time()
        if name not in QUERIES:
            print(f"{name}: no SQL", flush=True)
            continue
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # report every query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - start:.1f} s)", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
