import pytest

from compare import assert_same, duck
from factloom.jobs import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.limit(1).count() >= 0


def test_every_oracle_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
