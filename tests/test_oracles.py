"""Every core query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import pytest

from starloom.plans.catalog import registries
from tests.compare import connect, difference
from tests.conftest import SMALL

QUERIES = {name: (function, registry.oracles.get(name)) for registry in registries() for name, function in registry.queries.items()}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    function, sql = QUERIES[name]
    if sql is None:
        assert function(spark, SMALL).count() >= 0
    else:
        assert difference(function(spark, SMALL), duck, sql) == ""


def test_names_are_unique():
    names = [n for registry in registries() for n in registry.queries]
    assert len(names) == len(set(names))
