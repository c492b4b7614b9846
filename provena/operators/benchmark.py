"""Timing of candidates by one rule: a warm-up that does not count, then timed runs to a sink without
output. Timings are rows, so ratios and decisions are ordinary queries over them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "candidate string, step int, seconds double, warmup boolean"


def run(spark: SparkSession, candidates: dict[str, DataFrame], steps: int = 20, warmups: int = 1) -> DataFrame:
    """One row for each timed run (`warmup` false)."""
    rows = []
    for name, df in candidates.items():
        for i in range(warmups + steps):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            if i >= warmups:
                rows.append((name, i - warmups, time.perf_counter() - began, False))
    return spark.createDataFrame(rows, SCHEMA)
