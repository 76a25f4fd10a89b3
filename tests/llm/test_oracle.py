import pytest

from compare import assert_same, duck
from factloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert_same(queries()[name](spark, sf_dir), duck(sf_dir), oracle_sql()[name])
