"""Every registered query runs; those with SQL agree with DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    result = compare(spark, duck, SF_DIR, name, queries(), oracle_sql())
    assert result.startswith(("ok", "rows only")), result


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["lo", "hi"] and df.count() > 0
