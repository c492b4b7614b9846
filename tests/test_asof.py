"""As-of join against a plain scan: hot keys, ties, gaps of many blocks, rows before the first reading."""

from __future__ import annotations

import datetime
import random

import pytest

from provena.operators import asof

START = datetime.datetime(2024, 1, 1)


def when(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize(("width", "step"), [(60, 1000), (7, 50), (1, 100), (10**7, 1000)])
def test_last_reading(spark, monkeypatch, width, step):
    monkeypatch.setattr(asof, "STEP", step)
    rng = random.Random(width)
    key = lambda: 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None])
    times = lambda: rng.choice([rng.randint(0, 300), rng.randint(200_000, 200_400), rng.randint(0, 400_000)])
    readings = [(key(), times(), i, rng.choice([None, float(i)])) for i in range(250)] + [(1, 100, 900, 1.5), (1, 100, 901, 2.5), (1, None, 902, 9.0)]
    rows = [(i, key(), times()) for i in range(400)] + [(1000, 1, 100), (1001, 1, None), (1002, 9, 5), (1003, 1, -50)]
    a = spark.createDataFrame([(i, k, when(t)) for i, k, t in rows], "i long, k long, at timestamp")
    b = spark.createDataFrame([(k, when(t), n, v) for k, t, n, v in readings], "k long, ts timestamp, n long, v double")
    got = {r.i: (r.n, r.v) for r in asof.asof(a, b, ["k"], "at", "ts", ["n", "v"], width, "n").collect()}
    want = {}
    for i, k, t in rows:
        fit = [(u, n, v) for q, u, n, v in readings if k is not None and q == k and u is not None and t is not None and u <= t]
        want[i] = max(fit, key=lambda x: x[:2])[1:] if fit else (None, None)
    assert got == want
