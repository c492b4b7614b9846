"""Readings before and after each operator of a run, as a table.

A run is a stream over what its sources hold, in micro-batches. Observations stand between its operators and count the
rows that pass; a listener receives them with the times of each batch's phases and the sizes of states, and the readings
become a table of batch, operator, rows and milliseconds. The counting rides along with the run's own jobs.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

READING = "batch long, phase string, operator string, rows long, ms long"


def after(df: DataFrame, operator: str) -> DataFrame:
    """Counts the rows that leave an operator; what stands before the next one is its input."""
    return df.observe(operator, F.count(F.lit(1)).alias("rows"))


class Readings(StreamingQueryListener):
    """Collects the readings of one query by its name: a few numbers for each micro-batch."""

    def __init__(self, name: str):
        self.name, self.rows, self.ended, self.runs = name, [], threading.Event(), set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        for k, source in enumerate(p.sources):
            self.rows.append((p.batchId, "operator", f"source {k}", source.numInputRows, None))
        for operator, row in p.observedMetrics.items():
            self.rows.append((p.batchId, "operator", operator, row["rows"], None))
        for k, s in enumerate(p.stateOperators):
            self.rows.append((p.batchId, "state", f"state {k}", s.numRowsTotal, s.commitTimeMs))
        for phase, ms in p.durationMs.items():
            self.rows.append((p.batchId, "time", phase, None, ms))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, READING)


@contextlib.contextmanager
def listening(spark: SparkSession, name: str) -> Iterator[Readings]:
    """A listener for the query of that name; it is complete when the block ends."""
    readings = Readings(name)
    spark.streams.addListener(readings)
    try:
        yield readings
        if not readings.ended.wait(60):
            raise TimeoutError(f"no end of {name} was reported")
    finally:
        spark.streams.removeListener(readings)
