"""Run a query and its SQL twin and compare the rows as sorted text."""
import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    result = connection.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "strftime"):
        return pd.Timestamp(value).isoformat()
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if isinstance(value, str):
        return value
    return repr(number + 0.0)


def normalised(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(_cell(row[n]) for n in order) for row in rows)


def assert_same(spark_frame, sql: str, folder: str) -> int:
    want_columns, want_rows = oracle_rows(sql, folder)
    got_rows = [tuple(row) for row in spark_frame.collect()]
    assert sorted(spark_frame.columns) == sorted(want_columns)
    left = normalised(spark_frame.columns, got_rows)
    right = normalised(want_columns, want_rows)
    assert len(left) == len(right), f"{len(left)} rows, expected {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    assert not different, f"{len(different)} rows differ, first: {different[:2]}"
    return len(left)
