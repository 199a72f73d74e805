import pytest

from lattice.llm import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(name, spark, sf_dir):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)
