import pytest

from lodestore.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
