"""Every registered query with an oracle equals DuckDB on the same parquet."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import duck, rows_of

from .conftest import SF_ORACLE

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_ORACLE).toPandas()
    exp = con.execute(ORACLE[name]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(exp)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "total_sales_yoy_growth" in df.columns
