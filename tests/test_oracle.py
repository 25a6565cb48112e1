"""Every query with a SQL twin gives the same names, types and rows on DuckDB."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differences, duck

SF_DIR = os.environ.get("METRICWATCH_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    assert differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) == []


def test_entry(spark):
    df = entry(spark)
    assert df.columns == [
        "series", "ds", "trend", "yhat", "yhat_lower", "yhat_upper", "fact", "anomaly", "importance",
    ]
    assert df.count() > 0
