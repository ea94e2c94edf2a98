"""Parallel scan of a relational table, split on a numeric key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def split_predicates(
    column: str,
    lower: int,
    upper: int,
    splits: int,
    spread_column: str | None = None,
    spread: int = 1,
) -> list[str]:
    """WHERE clauses that cut a table into ranges of ``column``: each row is in just one.

    The first range is open below and has the nulls, the last is open above, so rows
    outside the given bounds are read too. A key that holds much of the table fills its
    range whatever its width; ``spread_column`` then cuts each range ``spread`` times more
    by a second numeric column.
    """
    if splits < 1 or spread < 1 or upper < lower:
        raise ValueError("splits and spread must be at least 1 and the bounds in order")
    width = -(-(upper - lower + 1) // splits)
    edges = [lower + i * width for i in range(1, splits) if lower + i * width <= upper]
    if not edges:
        ranges = ["1 = 1"]
    else:
        ranges = [f"({column} < {edges[0]} OR {column} IS NULL)"]
        ranges += [
            f"({column} >= {low} AND {column} < {high})"
            for low, high in zip(edges, edges[1:], strict=False)
        ]
        ranges.append(f"({column} >= {edges[-1]})")
    if spread_column is None or spread == 1:
        return ranges
    part = f"MOD(ABS({spread_column}), {spread})"
    parts = [f"({part} = 0 OR {spread_column} IS NULL)"]
    parts += [f"({part} = {i})" for i in range(1, spread)]
    return [f"{r} AND {p}" for r in ranges for p in parts]


def read_jdbc_split(
    spark: SparkSession,
    url: str,
    table: str,
    column: str = "user_id",
    splits: int = 3,
    properties: dict[str, str] | None = None,
    bounds: tuple[int, int] | None = None,
    spread_column: str | None = None,
    spread: int = 1,
) -> DataFrame:
    """All columns of ``table``, read over ``splits * spread`` connections.

    Without ``bounds`` the database is asked for the least and greatest key: one row.
    """
    properties = properties or {}
    if bounds is None:
        asked = f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) bounds"
        low, high = spark.read.jdbc(url, asked, properties=properties).first()
        bounds = (0, 0) if low is None else (int(low), int(high))
    predicates = split_predicates(column, *bounds, splits, spread_column, spread)
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
