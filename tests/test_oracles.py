import pytest
from oracle import compare, connect

from dossierlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    problem = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.count()
    assert rows > 0 and len(set(df.columns)) == len(df.columns)
    assert registry.QUERIES[name](spark, SF).schema == df.schema
