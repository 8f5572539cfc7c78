import pytest

import __spark_entry__
from lodestore.plans import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entity_query_runs(spark, sf):
    kinds = {r.kind for r in catalog.queries()["text_entities"](spark, sf).select("kind").distinct().collect()}
    assert "path" in kinds


def test_the_flagship_search_takes_every_stated_query(spark, sf):
    got = {r.query_id for r in __spark_entry__.entry(spark).select("query_id").distinct().collect()}
    assert got == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
