"""Gradient norms, clipping, and AdamW: one step, and an ordered fold over many steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources import shared

BETA1, BETA2, EPS, LR, DECAY = 0.9, 0.95, 1e-8, 1e-4, 0.1


def global_norm(g: DataFrame, col: str = "g") -> DataFrame:
    """One row: the norm over all values and the clip coefficient min(1, 1 / (norm + 1e-6))."""
    n = g.agg(F.sqrt(F.sum(F.col(col).cast("double") * F.col(col))).alias("norm"))
    return n.withColumn("clip", F.least(F.lit(1.0), 1 / (F.col("norm") + 1e-6)))


def norms(g: DataFrame, by: str, col: str = "g") -> DataFrame:
    return g.groupBy(by).agg(F.sqrt(F.sum(F.col(col).cast("double") * F.col(col))).alias("l2"), F.max(F.abs(F.col(col).cast("double"))).alias("max_abs"))


def adamw_step(w: Column, g: Column, decay: Column, lr: float = LR, beta1: float = BETA1, beta2: float = BETA2, eps: float = EPS) -> Column:
    """A first step from zero moments, where bias correction cancels the betas' scale."""
    m, v = (1 - beta1) * g / (1 - beta1), (1 - beta2) * g * g / (1 - beta2)
    return w - lr * decay * w - lr * m / (F.sqrt(v) + eps)


#: Steps of a key that are folded as one array, and steps of a block of longer histories.
WHOLE, BLOCK_BITS = 100_000, 12


def adamw_fold(steps: DataFrame, key: str, order: list[str], g: str, lr: float = LR, beta1: float = BETA1, beta2: float = BETA2, eps: float = EPS, decay: float | Column = DECAY, start: float = 1.0, whole: int = WHOLE) -> DataFrame:
    """State (w, m, v, steps) of each key after its steps in order; `decay` may be a column that is the same for all
    steps of a key (optimizer groups).

    A history of up to `whole` steps is one sorted array, folded where it was gathered. Longer ones are range-sorted
    and cut into blocks of 4,096 steps: blocks are summed up alone, a pass over these sums gives each block its
    start (the moments are linear in the past), and with the moments known a block changes w by one affine map. The
    passes over a key's blocks stream them one by one; nothing of the size of a history is in one place."""
    own = F.lit(float(decay)) if isinstance(decay, (int, float)) else decay
    narrow = steps.select(F.col(key).alias("key"), F.struct(*order, F.col(g).cast("double").alias("g")).alias("step"), own.cast("double").alias("decay"))
    rule = (lr, beta1, beta2, eps)
    long_ = narrow.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("key")
    if long_.isEmpty():
        return _short(narrow, rule, start).withColumnRenamed("key", key)
    spark = steps.sparkSession
    path = shared.folder(spark, "long-keys")
    long_.write.parquet(path)
    long_ = spark.read.schema(long_.schema).parquet(path)
    rest = _short(narrow.join(long_, "key", "left_anti"), rule, start)
    return rest.unionByName(_long(narrow.join(long_, "key", "left_semi"), rule, start)).withColumnRenamed("key", key)


def _moments(rule: tuple):
    _, beta1, beta2, _ = rule
    return lambda s, e: (beta1 * s["m"] + (1 - beta1) * e["g"], beta2 * s["v"] + (1 - beta2) * e["g"] * e["g"])


def _turn(rule: tuple, decay: Column):
    """One step on (a, b, m, v, b1, b2): w is a times the start's, plus b."""
    lr, beta1, beta2, eps = rule
    moments = _moments(rule)

    def turn(s: Column, e: Column) -> Column:
        m, v = moments(s, e)
        b1, b2 = s["b1"] * beta1, s["b2"] * beta2
        keep = 1 - lr * decay
        return F.struct((s["a"] * keep).alias("a"), (s["b"] * keep - lr * (m / (1 - b1)) / (F.sqrt(v / (1 - b2)) + eps)).alias("b"), m.alias("m"), v.alias("v"), b1.alias("b1"), b2.alias("b2"))

    return turn


def _short(narrow: DataFrame, rule: tuple, start: float) -> DataFrame:
    own = narrow.groupBy("key").agg(F.array_sort(F.collect_list("step")).alias("steps"), F.first("decay").alias("decay"))  # `whole` steps at most
    first = F.struct(*(F.lit(x).alias(c) for c, x in (("a", 1.0), ("b", 0.0), ("m", 0.0), ("v", 0.0), ("b1", 1.0), ("b2", 1.0))))
    done = own.select("key", F.aggregate("steps", first, _turn(rule, F.col("decay"))).alias("s"), F.size("steps").cast("long").alias("steps"))
    return done.select("key", (F.col("s.a") * start + F.col("s.b")).alias("w"), "s.m", "s.v", "steps")


def _long(narrow: DataFrame, rule: tuple, start: float) -> DataFrame:
    spark = narrow.sparkSession
    ship(spark)
    _, beta1, beta2, _ = rule
    path = shared.folder(spark, "steps")
    # Sorted rows are numbered inside each partition, in order; 4,096 numbers are a block.
    ranged = narrow.repartitionByRange("key", "step").sortWithinPartitions("key", "step").withColumn("at", F.monotonically_increasing_id())
    ranged.select("key", "at", F.col("step.g").alias("g"), "decay").write.parquet(path)
    rows = spark.read.parquet(path).withColumn("block", F.shiftright("at", BLOCK_BITS))
    blocks = rows.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("at", "g"))).alias("steps"), F.first("decay").alias("decay"))
    zero, moments = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v")), _moments(rule)

    def add(s: Column, e: Column) -> Column:
        m, v = moments(s, e)
        return F.struct(m.alias("m"), v.alias("v"))

    alone = blocks.select("key", "block", F.size("steps").cast("long").alias("n"), F.aggregate("steps", zero, add).alias("s")).select("key", "block", "n", "s.m", "s.v")
    kind = narrow.schema["key"].dataType.simpleString()
    by_key = lambda x: x.repartition("key").sortWithinPartitions("key", "block")
    begun = by_key(alone).mapInArrow(lambda it: _prefixes(it, beta1, beta2), f"key {kind}, block long, n0 long, m0 double, v0 double")
    first = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.col("m0").alias("m"), F.col("v0").alias("v"), F.pow(F.lit(beta1), "n0").alias("b1"), F.pow(F.lit(beta2), "n0").alias("b2"))
    maps = blocks.join(begun, ["key", "block"]).select("key", "block", (F.col("n0") + F.size("steps")).alias("n"), F.aggregate("steps", first, _turn(rule, F.col("decay"))).alias("s")).select("key", "block", "n", "s.a", "s.b", "s.m", "s.v")
    return by_key(maps).mapInArrow(lambda it: _chained(it, start), f"key {kind}, w double, m double, v double, steps long")


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _prefixes(batches: Iterator[pa.RecordBatch], beta1: float, beta2: float) -> Iterator[pa.RecordBatch]:
    """Steps and moments before each block, from the sums of blocks sorted by key: one block at a time."""
    key, n0, m0, v0 = None, 0, 0.0, 0.0
    for batch in batches:
        out = []
        for k, block, n, m, v in _columns(batch, "key", "block", "n", "m", "v"):
            if k != key:
                key, n0, m0, v0 = k, 0, 0.0, 0.0
            out.append((k, block, n0, m0, v0))
            n0, m0, v0 = n0 + n, m0 * beta1**n + m, v0 * beta2**n + v
        if out:
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "block", "n0", "m0", "v0"])


def _chained(batches: Iterator[pa.RecordBatch], start: float) -> Iterator[pa.RecordBatch]:
    """The last state of each key, from the maps of blocks sorted by key."""
    last, key, kind = None, None, None

    def row() -> pa.RecordBatch:
        types = [kind, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types, strict=True)], ["key", "w", "m", "v", "steps"])

    for batch in batches:
        kind = batch.column(0).type
        for k, n, a, b, m, v in _columns(batch, "key", "n", "a", "b", "m", "v"):
            if last and k != key:
                yield row()
                last = None
            key, last = k, (k, (last[1] if last else start) * a + b, m, v, n)
    if last:
        yield row()


def group_semantics(groups: DataFrame) -> DataFrame:
    """One row on optimizer groups (group_id, beta1, beta2, eps, names array): may they be used?
    Betas and eps must agree; several groups need names; no name may occur twice."""
    names = groups.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("if(n > 1, 1, 0)")), F.lit(0)).cast("long").alias("duplicates"))
    base = groups.agg(F.count("*").alias("groups"), F.countDistinct("beta1", "beta2", "eps").alias("settings"), F.bool_and(F.col("names").isNotNull()).alias("named"))
    both = base.join(names)  # one row each
    return both.withColumn("usable", (F.col("settings") == 1) & (F.col("duplicates") == 0) & ((F.col("groups") == 1) | F.col("named")))
