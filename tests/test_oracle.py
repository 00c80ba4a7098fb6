import pytest

from lodeline.plans import catalog
from tests.oracle import same, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
