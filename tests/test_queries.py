"""Every query of the core against its SQL twin, on the smallest tables."""

import pytest
from compare import assert_same, connection

from qoslattice.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert_same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLE_SQL[name])


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
