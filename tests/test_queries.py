"""Every registered query of the library against its SQL; those without SQL must run and return rows."""

import pytest

from loadgrid.plans import registry
from tests.oracle import DATA, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLE:
        assert_same(df, registry.ORACLE[name], con)
    else:
        assert df.count() > 0


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
