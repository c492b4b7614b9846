"""Throughput, ratios to the baseline, usefulness, choice, and the report document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed thresholds: useful, and good enough to be the canonical candidate.
USEFUL, CANONICAL = 1.5, 2.0


def throughput(steps: DataFrame, by: str, seconds: str, tokens: int = 256) -> DataFrame:
    """tokens * steps / max(1e-9, seconds), with the first and last loss and finiteness."""
    return steps.groupBy(by).agg(
        F.count("*").alias("steps"), F.sum(seconds).alias("seconds"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.bool_and(~F.isnan("loss")).alias("finite")
    ).withColumn("rate", F.col("steps") * tokens / F.greatest(F.lit(1e-9), F.col("seconds")))


def ratio(rate: Column, base: Column) -> Column:
    """Candidate to baseline; 0 if either is not positive."""
    return F.when((rate > 0) & (base > 0), rate / base).otherwise(0.0)


def against_baseline(bench: DataFrame, name: str, baseline: str) -> DataFrame:
    base = bench.filter(F.col(name) == baseline).select(F.col("rate").alias("base_rate"))
    return bench.join(F.broadcast(base), how="left").withColumn("ratio", ratio(F.col("rate"), F.coalesce("base_rate", F.lit(0.0)))).drop("base_rate")  # one row


def usefulness(ok: Column, ratio_: Column) -> Column:
    return F.when(ok & (ratio_ >= CANONICAL), "canonical").when(ok & (ratio_ >= USEFUL), "useful").otherwise("not useful")


def choose(candidates: DataFrame, name: str, priority: str) -> DataFrame:
    """The highest ratio; ties go to the lowest priority number."""
    return candidates.agg(F.max_by(name, F.struct("ratio", -F.col(priority))).alias("chosen"), F.max("ratio").alias("ratio"))


def report(rows: DataFrame, *fields: str) -> DataFrame:
    """One JSON document for each row, keys in sorted order and nulls kept; NaN becomes null first."""
    clean = [F.when(F.isnan(f), None).otherwise(F.col(f)).alias(f) if dict(rows.dtypes)[f] in ("double", "float") else F.col(f) for f in sorted(fields)]
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("report"))
