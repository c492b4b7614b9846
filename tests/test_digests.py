"""Digests of ordered states against hashlib, and the rules of a boundary one by one."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.operators import boundary, digests


@pytest.mark.parametrize("separator", [b"", b"--"])
def test_states_larger_than_a_chunk(spark, separator):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2, None]), i // 2, rng.randbytes(rng.choice([0, 3, 200_000]))) for i in range(150)] + [(1, 5, None), (3, 1, b"")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, o long, data binary").repartition(5)
    got = {r.k: (r.n, r.bytes, r.sha) for r in digests.ordered(df, ["k"], ["o"], F.col("data"), separator).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [d for q, _, d in sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: r[1:])]
        whole = separator.join(own)
        want[k] = (len(own), len(whole), hashlib.sha256(whole).hexdigest())
    assert got == want and want[1][1] > digests.CHUNK
    whole = separator.join(d for _, _, d in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1:]))
    assert digests.ordered(df, [], ["o"], F.col("data"), separator).first().sha == hashlib.sha256(whole).hexdigest()
    assert digests.ordered(df.limit(0), [], ["o"], F.col("data")).count() == 0


def test_a_state_of_tensors(spark):
    rng = np.random.default_rng(3)
    tensors = {f"layer.{i}": rng.normal(size=shape).astype("<f4") for i, shape in enumerate([(3, 4), (70000,), (), (0, 2), (2, 1, 5)])}
    rows = [(k, "torch.float32", list(v.shape), v.tobytes()) for k, v in tensors.items()]
    df = spark.createDataFrame(rows, "name string, kind string, shape array<long>, content binary")
    h = hashlib.sha256()
    for k in sorted(tensors):
        x = tensors[k]
        h.update(k.encode() + b"torch.float32" + struct.pack("<I", x.ndim) + b"".join(struct.pack("<Q", d) for d in x.shape) + x.tobytes())
    entry = digests.tensor_entry(*(F.col(c) for c in ("name", "kind", "shape", "content")))
    assert digests.ordered(df, [], ["name"], entry).first().sha == h.hexdigest()


FINE = {"step": "10", "stage_tokens": "20", "lifetime_tokens": "30"}
MARKER = {"status": "PASS", "stage_steps": "10", "final_model_state_sha256": "s", "test_split_used": "UNTOUCHED"}


def broken(spark, checkpoint=None, marker=None, agreement=None, state="s"):
    maps = "entity string, values map<string,string>"
    expected = spark.createDataFrame([("e", "s", 10, 20, 30)], "entity string, state string, step long, stage_tokens long, lifetime_tokens long")
    here = spark.createDataFrame([("e", state, FINE | (checkpoint or {}))], "entity string, state string, values map<string,string>")
    done = spark.createDataFrame([("e", MARKER | marker)] if marker is not None else [], maps)
    agreed = spark.createDataFrame([("e", agreement)] if agreement is not None else [], maps)
    hashes = spark.createDataFrame([("e", "d")], "entity string, data string")
    return sorted(r.rule for r in boundary.violations(expected, here, done, agreed, hashes).collect())


@pytest.mark.parametrize(
    ("found", "rules"),
    [
        ({}, []),
        ({"marker": {}, "agreement": {"train_bin_sha256": "d", "test_used": "false"}}, []),
        ({"state": "other"}, ["checkpoint state"]),
        ({"state": None}, ["checkpoint state"]),
        ({"checkpoint": {"stage_step": "11"}}, ["checkpoint step"]),  # an earlier name counts before `step`
        ({"checkpoint": {"stage_step": "x", "stage_steps": None}}, []),  # no number: the next name
        ({"checkpoint": {"stage_tokens": "21", "lifetime_tokens": "31"}}, ["checkpoint lifetime_tokens", "checkpoint stage_tokens"]),
        ({"marker": {"status": "FAIL"}}, ["marker status"]),
        ({"marker": {"status": None, "stage_steps": None, "final_model_state_sha256": ""}}, []),
        ({"marker": {"final_model_state_sha256": "", "final_model_sha": "t"}}, ["marker state"]),
        ({"marker": {"stage_steps": "9", "lifetime_tokens": "1"}}, ["marker lifetime_tokens", "marker step"]),
        ({"marker": {"test_split_used": "true"}}, ["marker test split"]),
        ({"marker": {"test_split_used": "0", "test_used": "yes"}}, ["marker test split"]),
        ({"agreement": {"dataset_v2_train_sha256": "d", "train_bin_sha256": "c"}}, ["contract data"]),
        ({"agreement": {"test_used": "1"}}, ["contract test split"]),
    ],
)
def test_rules_one_by_one(spark, found, rules):
    assert broken(spark, **found) == rules


@pytest.mark.parametrize("separator", [b"", b"--"])
def test_long_states_in_links(spark, monkeypatch, separator):
    """A long state is digested by several jobs, each of which reads a link of it; short ones end in their task."""
    monkeypatch.setattr(digests, "CHUNK", 1000)
    monkeypatch.setattr(digests, "LINK", 400_000)
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, None, *range(2, 60)]), i // 2, rng.randbytes(rng.choice([0, 3, 400, 2500]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, data binary").repartition(5)
    for keys in (["k"], []):
        got = {r.k if keys else 0: (r.n, r.bytes, r.sha) for r in digests.ordered(df, keys, ["o"], F.col("data"), separator).collect()}
        want = {}
        for k in {r[0] for r in rows} if keys else {0}:
            own = [d for _, _, d in sorted((r for r in rows if not keys or r[0] == k), key=lambda r: r[1:])]
            whole = separator.join(own)
            want[k] = (len(own), len(whole), hashlib.sha256(whole).hexdigest())
        assert got == want
    assert want[0][1] > 4 * digests.LINK
