"""Runs a registered query and its SQL counterpart and compares the results."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "is_integer") or isinstance(value, int):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def run_sql(sql: str, sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def compare(df, sql: str, sf_dir: str):
    """None if equal, else a message; and the number of rows."""
    spark_rows = df.collect()
    columns, sql_rows = run_sql(sql, sf_dir)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(spark_rows)
    a, b = rows_of(df.columns, spark_rows), rows_of(columns, sql_rows)
    if a == b:
        return None, len(a)
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"{len(a)} vs {len(b)} rows; only spark {only_a}; only sql {only_b}", len(a)
