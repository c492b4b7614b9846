"""Softmax over long rows: states that merge in any order, null keys, and a hot row that is no single task."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.operators import longrows

SCHEMA = "g long, h string, i long, x double, vec array<double>"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        g = 7 if i % 3 else int(rng.integers(0, 400))
        rows.append((None if g == 3 else g, "a" if i % 2 else None, i, float(rng.normal() * 200) if i % 50 else None, rng.normal(size=3).tolist()))
    rows += [(9001, "b", 1, -math.inf, [0.0] * 3), (9001, "b", 2, 0.5, [1.0] * 3), (9002, "b", 3, -900.0, [2.0] * 3)]
    return rows


def brute(items):
    rows = {}
    for g, h, i, x, v in items:
        if x is not None:
            rows.setdefault((g, h), []).append((i, x, np.array(v)))
    out = {}
    for k, own in rows.items():
        m = max(x for _, x, _ in own)
        e = [math.exp(x - m) for _, x, _ in own]
        out[k] = (m + math.log(sum(e)), {i: p / sum(e) for (i, _, _), p in zip(own, e, strict=True)}, sum(p * v for (_, _, v), p in zip(own, e, strict=True)) / sum(e), len(own))
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_states_merge_in_any_order(spark, items, parts):
    df = spark.createDataFrame(items, SCHEMA).repartition(parts, F.xxhash64("i"))
    want = brute(items)
    lse = {(r.g, r.h): (r.n, r.lse) for r in longrows.log_sum_exp(df, ["g", "h"]).collect()}
    assert lse.keys() == want.keys() and all(lse[k][0] == want[k][3] and abs(lse[k][1] - want[k][0]) < 1e-9 for k in want)
    p = longrows.softmax(df, ["g", "h"]).collect()
    assert len(p) == sum(w[3] for w in want.values()) and all(abs(r.p - want[r.g, r.h][1][r.i]) < 1e-12 for r in p)
    logp = longrows.log_softmax(df.filter("x > -1e9"), ["g", "h"]).collect()
    assert all(abs(r.logp - math.log(max(want[r.g, r.h][1][r.i], 1e-300))) < 1e-6 for r in logp if want[r.g, r.h][1][r.i] > 1e-250)
    y = {(r.g, r.h): r.y for r in longrows.attention(df, ["g", "h"], "x", "vec").collect()}
    assert all(np.allclose(y[k], want[k][2]) for k in want)


def test_a_hot_row_is_shuffled_as_states(spark):
    """A row with a third of all items reaches the shuffle as one state for each batch of a task."""
    df = spark.range(0, 90_000, 1, 9).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"), (F.col("id") % 97).cast("double").alias("x"))
    named = df.select("g", "x")
    parts = named.mapInArrow(lambda it: longrows._partial(it, ["g"], False), "g long, salt long, n long, m double, s double")
    hot = parts.filter("g = -1").agg(F.count("*"), F.sum("n"), F.countDistinct("salt")).first()
    assert hot[0] <= 18 and hot[1] == 30_000 and hot[2] == 9
    assert longrows.softmax(df, ["g"]).groupBy("g").agg(F.sum("p").alias("p")).filter("abs(p - 1) > 1e-9").isEmpty()


def test_nothing(spark):
    assert longrows.softmax(spark.createDataFrame([], SCHEMA), ["g"]).collect() == []
