"""Running sums over histories of any length: sums inside blocks of the order, and the offsets of the blocks before.

A block is a range of the order column, so no window holds more than a key's rows of one block, and the windows over
blocks hold one small row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, block: Column, name: str = "running") -> DataFrame:
    """The rows with the sum of `value` over their key's rows up to and including their own. `block` must not decrease
    along `order`. Null keys are a key of their own; nulls add nothing, and before the first value the sum is null."""
    named = rows.withColumn("running_block", block)
    inside = Window.partitionBy(key, "running_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = named.groupBy(F.col(key).alias("running_key"), F.col("running_block").alias("of_block")).agg(F.sum(value).alias("whole"))
    before = sums.withColumn("before", F.sum("whole").over(Window.partitionBy("running_key").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1))).drop("whole")
    both = named.withColumn("own", F.sum(value).over(inside)).join(before, F.col(key).eqNullSafe(F.col("running_key")) & F.col("running_block").eqNullSafe(F.col("of_block")))
    total = F.when(F.col("own").isNotNull() | F.col("before").isNotNull(), F.coalesce("own", F.lit(0)) + F.coalesce("before", F.lit(0)))
    return both.select(*rows.columns, total.alias(name))
