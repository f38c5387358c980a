import pytest

from loomvec import queries, queries_checks, queries_manifest, queries_more  # noqa: F401
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_oracle(spark, con, sf_dir, name):
    assert_same(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_seeded_queries_repeat(spark, sf_dir, name):
    first, second = (sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
