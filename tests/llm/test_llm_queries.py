import pytest

from tests.oracle import same_rows
from weblake.llm import registry


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_all_are_registered():
    assert sorted({int(n.split("_")[0][2:]) for n in registry.QUERIES}) == list(range(1, 14))
