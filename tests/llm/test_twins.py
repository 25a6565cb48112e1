"""Every query with a SQL twin gives the same names, types and rows on DuckDB."""

import os

import pytest

from compare import differences, duck
from metricwatch.llm.queries import oracle_sql, queries

SF_DIR = os.environ.get("METRICWATCH_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    assert differences(queries()[name](spark, SF_DIR), duck(SF_DIR), oracle_sql()[name]) == []
