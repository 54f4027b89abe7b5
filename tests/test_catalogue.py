import pytest

from tessera.plans import catalogue

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf01, name):
    sql = catalogue.oracle_sql().get(name)
    if sql:
        compare(spark, sf01, catalogue.queries()[name], sql)
    else:
        assert catalogue.queries()[name](spark, sf01).count() > 0
