import pytest

from compare import connect, same
from conftest import SF
from sheafwork.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0
