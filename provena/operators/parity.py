"""Measured values against reference values: errors, thresholds, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed thresholds of the parity rule.
LOSS_ABS, LOGIT_ABS, NORM_REL, GRAD_ABS, ADAM_ABS = 2e-3, 5e-3, 2e-2, 5e-3, 5e-4


def abs_error(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def rel_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.lit(1e-12), F.abs(a), F.abs(b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def compare(measured: DataFrame, reference: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Errors of `got` against `want` for each candidate; NaN fails a threshold and is counted."""
    both = measured.join(reference, keys)
    return both.groupBy(*by).agg(
        F.count("*").alias("probes"), F.max(abs_error(F.col("got"), F.col("want"))).alias("max_abs"), F.max(rel_error(F.col("got"), F.col("want"))).alias("max_rel"),
        F.sqrt(F.sum(F.col("got") * F.col("got"))).alias("got_norm"), F.sqrt(F.sum(F.col("want") * F.col("want"))).alias("want_norm"), F.sum(F.isnan("got").cast("long")).alias("n_nan"),
    )


def verdict(errors: DataFrame, max_abs: float = LOGIT_ABS, norm_rel: float = NORM_REL) -> DataFrame:
    rel = rel_error(F.col("got_norm"), F.col("want_norm"))
    return errors.withColumn("norm_rel", rel).withColumn("pass", (F.col("max_abs") <= max_abs) & (rel <= norm_rel) & (F.col("n_nan") == 0))
