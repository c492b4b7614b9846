"""As-of join: the last reading at or before each row's time, without a window over a whole key.

Time is cut into blocks. Inside a block of a key, a window finds the last reading before each row; a row that has
none there takes the last reading of the nearest earlier block that has one. That is found in the same way, with
blocks as rows and STEP of them as a block, until few are left, so no task sorts more than a block of readings or
STEP small rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 1000


def _carried(last: DataFrame, keys: list[str], widest: int) -> DataFrame:
    """(keys, block, last) with `before`: the last reading of the nearest earlier block that has one."""
    own = Window.partitionBy(*keys, "upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = last.withColumn("upper", F.floor(F.col("block") / STEP).cast("long")).withColumn("before", F.last("last", ignorenulls=True).over(own))
    if widest < STEP:
        all_ = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.last("last", ignorenulls=True).over(all_)).drop("upper")
    up = rows.groupBy(*keys, F.col("upper").alias("block")).agg(F.max("last").alias("last"))
    above = _carried(up, keys, widest // STEP + 1).select(*keys, F.col("block").alias("upper"), F.col("before").alias("above"))
    return rows.join(above, [*keys, "upper"]).select(*keys, "block", "last", F.coalesce("before", "above").alias("before"))


def asof(rows: DataFrame, readings: DataFrame, keys: list[str], at: str, time: str, value: list[str], width: int, tie: str | None = None) -> DataFrame:
    """`rows` with the columns `value` of the last of `readings` with the same keys and `time` <= `at`; null without
    one, and where a key or the time is null. Times are timestamps, `width` is a block's seconds, and of readings of one time the one with the greatest
    `tie` counts. Names beginning with `asof_` are the operator's own."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kinds = {c: readings.schema[c].dataType.simpleString() for c in value}
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    point = readings.dropna(subset=[*keys, time]).select(*(F.col(k).alias(f"asof_{k}") for k in keys), micros(time).alias("t"), F.struct(micros(time).alias("t"), order.alias("tie"), *value).alias("last"))
    asked = rows.select(*(F.col(k).alias(f"asof_{k}") for k in keys), micros(at).alias("t"), F.struct(*(F.col(c) for c in rows.columns)).alias("asof_row"))
    own = [f"asof_{k}" for k in keys]
    block = F.floor(F.col("t") / (width * 1_000_000)).cast("long")
    point, asked = point.withColumn("block", block), asked.withColumn("block", block)
    last = point.groupBy(*own, "block").agg(F.max("last").alias("last"))
    # Blocks that are asked for and hold no reading take part as empty rows.
    asks = asked.filter("block is not null").select(*own, "block").distinct().join(last, [*own, "block"], "left_anti")
    blocks = last.unionByName(asks.withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    ends = blocks.agg(F.min("block"), F.max("block")).first()
    before = _carried(blocks, own, (ends[1] or 0) - (ends[0] or 0) + 1).select(*own, "block", "before")
    both = point.select(*own, "block", "t", F.lit(0).alias("side"), F.col("last.tie").alias("tie"), "last", F.lit(None).cast(asked.schema["asof_row"].dataType).alias("asof_row"))
    both = both.unionByName(asked.select(*own, "block", "t", F.lit(1).alias("side"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(last.schema["last"].dataType).alias("last"), "asof_row"))
    inside = Window.partitionBy(*own, "block").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen", F.last("last", ignorenulls=True).over(inside)).filter("side = 1")
    out = seen.join(before, [*own, "block"], "left").select("asof_row.*", F.coalesce("seen", "before").alias("asof_found"))
    return out.select(*rows.columns, *(F.col(f"asof_found.{c}").cast(kinds[c]).alias(c) for c in value))
