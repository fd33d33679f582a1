"""Every registered query with SQL gives the same columns, types and rows on Spark and on DuckDB."""

import pytest
from compare import compare, connect
from conftest import SMALL

from cohortspan.plans.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], SMALL) == ""


def test_every_query_has_sql():
    assert sorted(set(queries()) - set(oracle_sql())) == []


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["UserID", "Age", "BioAgeYears", "AgeGap", "Status"]
    assert df.count() > 0
