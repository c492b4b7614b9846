"""The fold over histories of any length against plain steps, in one array and in blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.operators import optimizer


def plain(g, lr, b1, b2, eps, decay, w=1.0):
    m = v = 0.0
    for n, x in enumerate(g, 1):
        m, v = b1 * m + (1 - b1) * x, b2 * v + (1 - b2) * x * x
        w = w - lr * decay * w - lr * (m / (1 - b1**n)) / ((v / (1 - b2**n)) ** 0.5 + eps)
    return w, m, v, len(g)


@pytest.mark.parametrize(("whole", "bits"), [(100_000, 12), (40, 3), (0, 5)])
def test_fold(spark, monkeypatch, whole, bits):
    monkeypatch.setattr(optimizer, "BLOCK_BITS", bits)
    rng = np.random.default_rng(whole)
    g = {k: rng.normal(size=n) for k, n in ((1, 900), (2, 40), (3, 41), (4, 1), (None, 60))}
    g[2][5:] = 0.0
    rows = [(k, i, float(x)) for k, own in g.items() for i, x in enumerate(own)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k long, i long, g double").filter("k is not null").repartition(5)
    decay = F.when(F.col("k") % 2 == 0, 0.3).otherwise(0.0)
    got = {r.k: r for r in optimizer.adamw_fold(df, "k", ["i"], "g", lr=1e-2, beta2=0.999, decay=decay, whole=whole).collect()}
    assert got.keys() == g.keys() - {None}
    for k, own in got.items():
        w, m, v, n = plain(g[k], 1e-2, 0.9, 0.999, 1e-8, 0.3 if k % 2 == 0 else 0.0)
        assert own.steps == n and abs(own.w - w) < 1e-9 and abs(own.m - m) < 1e-12 and abs(own.v - v) < 1e-12


def test_blocks_have_a_fixed_size(spark):
    df = spark.range(50_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("g"))
    narrow = df.select(F.col("k").alias("key"), F.struct("i", "g").alias("step"), F.lit(0.0).alias("decay"))
    sorted_ = narrow.repartitionByRange("key", "step").sortWithinPartitions("key", "step").withColumn("block", F.shiftright(F.monotonically_increasing_id(), optimizer.BLOCK_BITS))
    assert sorted_.groupBy("key", "block").count().agg(F.max("count")).first()[0] <= 4096
    a, b = (optimizer.adamw_fold(df, "k", ["i"], "g", whole=w).first() for w in (10**6, 1000))
    assert abs(a.w - b.w) < 1e-9 and abs(a.v - b.v) < 1e-9
