import pytest

from tests.oracle import same_rows
from weblake.jobs import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        same_rows(df, registry.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert "site" in e.entry(spark).columns
