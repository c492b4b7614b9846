"""Draws that equal NumPy's, for every name of the tables and for awkward bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from provena.functions import sampling
from provena.plans import registry

from . import oracle


def numpys(name, n, count=16):
    seed = int(hashlib.sha256(name.encode()).hexdigest()[:16], 16)
    return sorted({int(x) for x in np.random.default_rng(seed).integers(0, n, size=count)})


@pytest.mark.parametrize("size", [1, 2, 3, 7, 384, 2**31 + 1, 2**32 - 1, 2**32, 2**32 + 1, 3 * 2**61, 2**63 - 1])
def test_generators(size):
    """Bounds near powers of two reject about half of the draws."""
    seeds = np.array([0, 1, 2**32 - 1, 2**32, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**63, 40)], np.uint64)
    g = sampling.Generators(seeds)
    got = np.stack([g.below(np.full(len(seeds), size, np.uint64)) for _ in range(50)], axis=1)
    for s, own in zip(seeds.tolist(), got.tolist(), strict=True):
        assert own == np.random.default_rng(s).integers(0, size, size=50).tolist()


def test_every_part(spark):
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{oracle.SMALL}/part.parquet").collect()}
    got = registry.QUERIES["x23_numpy_probes"](spark, oracle.SMALL).collect()
    assert len(got) == len(parts)
    for r in got:
        p = parts[r.p_partkey]
        assert r.probes == numpys(p.p_name, (p.p_partkey + 1) * p.p_size * (2**33 if p.p_partkey % 2 == 0 else 1))


def test_every_nation(spark):
    names = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{oracle.SMALL}/nation.parquet").collect()}
    own = {}
    for r in spark.read.parquet(f"{oracle.SMALL}/supplier.parquet").collect():
        own.setdefault(r.s_nationkey, []).append(r.s_suppkey)
    want = {(k, i, sorted(s)[i]) for k, s in own.items() for i in numpys(names[k], len(s))}
    assert {tuple(r) for r in registry.QUERIES["g05_numpy_draw"](spark, oracle.SMALL).collect()} == want


def test_names_without_bounds(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "a", 0), (3, "a", None), (4, "é", 9)], "k long, n string, s long")
    assert [(r.key, r.probes) for r in sampling.numpy_probes(d, "k", "n", "s").collect()] == [(4, numpys("é", 9))]
