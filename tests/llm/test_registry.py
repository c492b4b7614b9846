from __future__ import annotations

import pytest

from provena.llm import registry

from .. import oracle


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name):
    assert oracle.difference(registry.QUERIES[name](spark, oracle.SMALL), registry.SQL[name], oracle.connect(oracle.SMALL)) == ""


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
