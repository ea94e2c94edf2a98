"""Spark results against DuckDB results as multisets of rows."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("basketlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "localhost")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duckdb_on(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _value(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, Decimal):
        return str(value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


SAME_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "decimal(10,2)": "DECIMAL(10,2)",
}


def differences(
    result: DataFrame, connection: duckdb.DuckDBPyConnection, statement: str | None
) -> str:
    """Empty when both have the same columns, types and rows."""
    if statement is None:
        return "" if result.count() else "no rows and no SQL"
    relation = connection.sql(statement)
    expected_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    types = {name: SAME_TYPES[kind] for name, kind in result.dtypes}
    if types != expected_types:
        return f"types {types} but SQL has {expected_types}"
    found = rows_of(result.columns, result.collect())
    expected = rows_of(relation.columns, relation.fetchall())
    if found == expected:
        return ""
    more, less = found - expected, expected - found
    return (
        f"{found.total()} rows, SQL {expected.total()};"
        f" only Spark {str(more.most_common(2))[:300]}; only SQL {str(less.most_common(2))[:300]}"
    )
