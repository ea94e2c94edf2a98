"""Every registered query against its SQL, and the registry against itself."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from basketlens.registry import QUERIES
from tests.compare import differences, duckdb_on

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return duckdb_on(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    assert differences(queries()[name](spark, SF), sql, oracle_sql()[name]) == ""


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["category_label", "score", "rk", "dt"]
    assert result.count() > 0
