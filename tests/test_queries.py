"""Every registered query against its SQL, on the smallest tables."""

import pytest
from isogloss.plans import registry
from oracle import assert_same, connect

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_whole_names():
    """These mean the same as the names without, which run below."""
    for name in registry.WHOLE:
        assert registry.QUERIES[f"{name}_whole"] is registry.QUERIES[name] and registry.ORACLE_SQL.get(f"{name}_whole") == registry.ORACLE_SQL.get(name)


NAMES = [n for n in registry.QUERIES if n.removesuffix("_whole") not in registry.WHOLE or not n.endswith("_whole")]


@pytest.mark.parametrize("name", sorted(set(NAMES) & set(registry.ORACLE_SQL)))
def test_oracle(spark, con, sf, name):
    assert_same(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
