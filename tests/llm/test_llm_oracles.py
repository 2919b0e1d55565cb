"""Every query for training data against its oracle, or at least run, on the smallest tables."""

from __future__ import annotations

import pytest

from starloom.llm.queries import registry
from tests.compare import connect, difference
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query(spark, duck, name):
    function, sql = registry.queries[name], registry.oracles.get(name)
    if sql is None:
        assert function(spark, SMALL).count() > 0
    else:
        assert difference(function(spark, SMALL), duck, sql) == ""
