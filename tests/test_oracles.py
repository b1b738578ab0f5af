"""Every registered query of the engine runs on the smallest data; those with SQL give the same rows."""

import pytest

from docweft.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    if name in registry.oracles():
        compare(df, db, registry.oracles()[name])
    else:
        assert df.count() >= 0
