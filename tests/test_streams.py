"""Streams over several files, in any order, one file a micro-batch: nothing is lost."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from provena.operators import optimizer
from provena.plans import registry, stream_queries
from provena.streaming import telemetry

from . import oracle


@pytest.fixture
def scattered(spark, tmp_path):
    """The events in eight files, by a hash or in ranges of time that are read in another order."""

    def write(by_time: bool) -> str:
        e = spark.read.parquet(f"{oracle.TINY}/events.parquet")
        parts = (e.repartitionByRange(8, "ts") if by_time else e.repartition(8, "event_id")).write.parquet
        parts(f"{tmp_path}/events.parquet")
        files = sorted((tmp_path / "events.parquet").glob("part-*"))
        random.Random(3).shuffle(files)
        for i, f in enumerate(files):  # the source reads by modification time
            import os

            os.utime(f, (time.time() - 1000 + 10 * i,) * 2)
        assert len(files) == 8
        return str(tmp_path)

    return write


@pytest.mark.parametrize("by_time", [False, True])
@pytest.mark.parametrize("name", ["stream_tumbling_throughput", "stream_adamw_state", "u02_a12_operator_callbacks"])
def test_any_order_of_files(spark, scattered, monkeypatch, name, by_time):
    monkeypatch.setattr(stream_queries, "FILES", 1)
    folder = scattered(by_time)
    assert oracle.difference(registry.QUERIES[name](spark, folder), registry.SQL[name], oracle.connect(folder)) == ""


def _run(spark, folder, steps, patience=600_000, later=()):
    schema, out = "k long, step long, g double", []
    for part in steps:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)

    def keep(batch, n):
        out.extend((n, r) for r in batch.collect())

    with telemetry.rocksdb(spark):
        for more in (None, *later):
            if more:
                spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            telemetry.adamw_state(source, "k", patience_ms=patience).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return out


def test_shuffled_steps_equal_the_fold(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, s, float(rng.normal())) for k in range(3) for s in range(1, 25)]
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    parts = [mixed[i::6] for i in range(6)]
    parts[3] += parts[1][:5]  # read twice
    out = _run(spark, tmp_path, parts)
    assert any(r.waiting for _, r in out)
    fold = {r.k: r for r in optimizer.adamw_fold(spark.createDataFrame(rows, "k long, step long, g double"), "k", ["step"], "g", decay=0.0).collect()}
    for k in range(3):
        last = max((r for _, r in out if r.key == k), key=lambda r: r.n)
        assert last.n == fold[k].steps == 24 and last.waiting == 0
        assert abs(last.w - fold[k].w) < 1e-12 and abs(last.m - fold[k].m) < 1e-12 and abs(last.v - fold[k].v) < 1e-12


def test_a_gap_is_told_and_closed_after_a_restart(spark, tmp_path):
    out = _run(spark, tmp_path, [[(1, 1, 0.5), (1, 4, 0.1)], [(1, 3, 0.2), (2, 1, 1.0)], [(3, 1, 1.0)]], patience=0, later=([(1, 2, 0.3)],))
    gap = [r for _, r in out if r.missing is not None]
    assert gap and {(r.key, r.missing, r.n) for r in gap} == {(1, 2, 1)} and max(r.waiting for r in gap) == 2
    done = [r for _, r in out if r.key == 1 and r.n == 4]
    assert done and done[-1].waiting == 0
