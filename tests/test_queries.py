import pytest
from oracle import connect, same

from briefspark.plans.queries import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, sf_dir, name):
    query, sql = QUERIES[name]
    same(query(spark, sf_dir), connect(sf_dir), sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
