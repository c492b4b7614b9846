"""Softmax, log-sum-exp and attention over rows of any length.

A row's state is (n, m, s, v): its items, their maximum, the sum of exp(x - m), and the sum of exp(x - m) times a vector.
States of parts of a row merge in any order, so a row is never gathered: tasks make one state for each row in
each batch, and these merge in two levels, first by row and salt, then by row. To give every item its share, the
states of long rows (a thousandth of all items or more, so a thousand rows at most) are broadcast, and the others are
joined by a shuffle, in which no row is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SALTS, LONG = 64, 1000


def _groups(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its group, and each group's first row; nulls are a value of their own."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], wide: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS
    for batch in batches:
        x = batch.column(batch.schema.get_field_index("x")).to_numpy(zero_copy_only=False)
        if not len(x):
            continue
        number, first = _groups(batch, keys)
        order = np.argsort(number, kind="stable")
        cut = np.searchsorted(number[order], np.arange(len(first)))
        m = np.maximum.reduceat(x[order], cut)
        e = np.exp(x[order] - np.where(np.isfinite(m), m, 0.0)[number[order]])
        n = np.diff(np.append(cut, len(x)))
        cols = [*(batch.column(batch.schema.get_field_index(k)).take(pa.array(first)) for k in keys), pa.array(np.full(len(first), salt)), pa.array(n), pa.array(m), pa.array(np.add.reduceat(e, cut))]
        if wide:
            col = batch.column(batch.schema.get_field_index("vec"))
            v = col.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)[order]
            sums = np.add.reduceat(e[:, None] * v, cut, axis=0)
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel())))
        yield pa.RecordBatch.from_arrays(cols, [*keys, "salt", "n", "m", "s", *["v"] * wide])


def _merged(states: DataFrame, keys: list[str], wide: bool) -> DataFrame:
    fields = ["n", "m", "s", *["v"] * wide]
    lists = states.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("l"), F.max("m").alias("m"), F.sum("n").alias("n"))
    scale = lambda e: F.when(e["m"] == F.col("m"), 1.0).otherwise(F.exp(e["m"] - F.col("m")))
    s = F.aggregate("l", F.lit(0.0), lambda a, e: a + e["s"] * scale(e))
    out = lists.select(*keys, "n", "m", s.alias("s"), "l")
    if wide:
        zero = F.transform(F.element_at("l", 1)["v"], lambda _: F.lit(0.0))
        out = out.withColumn("v", F.aggregate("l", zero, lambda a, e: F.zip_with(a, e["v"], lambda p, q: p + q * scale(e))))
    return out.select(*keys, *fields)


def states(items: DataFrame, keys: list[str], x: str = "x", vec: str | None = None) -> DataFrame:
    """(keys, n, m, s[, v]) of every row; items without a value do not count."""
    ship(items.sparkSession)
    wide = vec is not None
    named = items.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), *([F.transform(vec, lambda e: e.cast("double")).alias("vec")] if wide else []))
    types = ", ".join(f"{k} {named.schema[k].dataType.simpleString()}" for k in keys)
    parts = named.mapInArrow(lambda it: _partial(it, keys, wide), f"{types}, salt long, n long, m double, s double" + ", v array<double>" * wide)
    return _merged(_merged(parts, [*keys, "salt"], wide), keys, wide)


def log_sum_exp(items: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    return states(items, keys, x).select(*keys, "n", (F.col("m") + F.log("s")).alias("lse"))


def _with_states(items: DataFrame, keys: list[str], x: str, share: Column, name: str) -> DataFrame:
    from ..sources import shared

    spark = items.sparkSession
    path = shared.folder(spark, "states")
    states(items, keys, x).write.parquet(path)
    all_ = spark.read.parquet(path).select(*(F.col(k).alias(f"of_{k}") for k in keys), "n", "m", "s")
    total = all_.agg(F.sum("n")).first()[0] or 0
    match = None
    for k in keys:
        own = F.col(k).eqNullSafe(F.col(f"of_{k}"))
        match = own if match is None else match & own
    rows = items.filter(F.col(x).isNotNull())
    both = rows.join(F.broadcast(all_.filter(F.col("n") * LONG >= total)), match, "left")  # LONG rows at most
    long_ = both.filter("n is not null").select(*items.columns, share.alias(name))
    rest = both.filter("n is null").select(*items.columns).join(all_.filter(F.col("n") * LONG < total), match).select(*items.columns, share.alias(name))
    return long_.unionByName(rest)


def softmax(items: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """The items with `p`, their share of their row."""
    return _with_states(items, keys, x, F.exp(F.col(x) - F.col("m")) / F.col("s"), "p")


def log_softmax(items: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    return _with_states(items, keys, x, F.col(x) - F.col("m") - F.log("s"), "logp")


def attention(scores: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    """(keys, y): softmax of each row's scores times its items' vectors, from merged states alone."""
    return states(scores, keys, x, value).select(*keys, F.transform("v", lambda e: e / F.col("s")).alias("y"))
