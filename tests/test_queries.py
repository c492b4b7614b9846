"""Every query with SQL gives the same rows, and every query without it runs."""

from __future__ import annotations

import pytest

from . import oracle
from provena.plans import registry


@pytest.mark.parametrize("sf_dir", [oracle.TINY, oracle.SMALL])
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name, sf_dir):
    assert oracle.difference(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], oracle.connect(sf_dir)) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, oracle.TINY).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
