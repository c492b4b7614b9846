"""Telemetry as streams: tumbling windows with watermarks, and optimizer state by step."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship


def throughput(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their summed value by tumbling window and type; works on batches and streams. On a stream,
    `late` must cover how far files may be out of order: what comes later is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    g = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(out: DataFrame, path: str, state: str) -> None:
    """All that the sources of `out` hold now, appended to `path`; a later call goes on from there."""
    out.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with several variables of a key needs the RocksDB store; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


class InOrder(StatefulProcessor):
    """AdamW of one key whose steps are numbered from 1 and come in any order. A step waits in a keyed buffer
    until all before it are in; one that was applied or waits already is dropped, as files may be read twice. While
    steps wait, a timer is set; when it runs out, a row tells which step is missing and how many wait."""

    def __init__(self, lr: float, beta1: float, beta2: float, eps: float, patience_ms: int):
        self.rule, self.patience = (lr, beta1, beta2, eps), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("adamw", "w double, m double, v double, n long, waiting long")
        self.buffer = handle.getMapState("waiting", "step long", "g double")

    def _apply(self, s: tuple, g: float) -> tuple:
        (lr, b1, b2, eps), (w, m, v, n, waiting) = self.rule, s
        n, m, v = n + 1, b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
        return w - lr * (m / (1 - b1**n)) / ((v / (1 - b2**n)) ** 0.5 + eps), m, v, n, waiting

    def _row(self, key: tuple, s: tuple, missing: int | None) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "w": [s[0]], "m": [s[1]], "v": [s[2]], "n": [s[3]], "waiting": [s[4]], "missing": pd.array([missing], "Int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.state.get() or (1.0, 0.0, 0.0, 0, 0)
        now = 0
        for part in rows:
            part, now = part.sort_values("step"), int(part["arrived"].max().timestamp() * 1000)
            for step, g in zip(part["step"].tolist(), part["g"].tolist(), strict=True):
                if step == s[3] + 1:
                    s = self._apply(s, g)
                elif step > s[3] and not (s[4] and self.buffer.containsKey((step,))):
                    self.buffer.updateValue((step,), (g,))
                    s = (*s[:4], s[4] + 1)
            while s[4] and self.buffer.containsKey((s[3] + 1,)):  # its predecessors are in now
                step = s[3] + 1
                s = self._apply(s, self.buffer.getValue((step,))[0])
                self.buffer.removeKey((step,))
                s = (*s[:4], s[4] - 1)
        self.state.update(s)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if s[4]:
            self.handle.registerTimer(now + self.patience)
        yield self._row(key, s, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.state.get()
        yield self._row(key, s, s[3] + 1)

    def close(self) -> None:
        pass


def adamw_state(steps: DataFrame, key: str, lr: float = 1e-4, beta1: float = 0.9, beta2: float = 0.95, eps: float = 1e-8, patience_ms: int = 600_000) -> DataFrame:
    """A stream of (key, step, g), steps numbered from 1 by key, in any order and any batches: the state (w, m, v, n
    steps, steps waiting) of each key after each micro-batch it had rows in, and rows with `missing` for gaps that
    last. To be started inside `rocksdb`, in update mode."""
    ship(steps.sparkSession)
    named = steps.select(F.col(key).cast("long").alias("key"), F.col("step").cast("long").alias("step"), F.col("g").cast("double").alias("g"), F.current_timestamp().alias("arrived"))
    out = "key long, w double, m double, v double, n long, waiting long, missing long"
    return named.withWatermark("arrived", "0 seconds").groupBy("key").transformWithStateInPandas(InOrder(lr, beta1, beta2, eps, patience_ms), out, "Update", "EventTime")
