"""Connected components over links, for near-duplicate groups.

Union-find runs twice: inside each partition, where it turns that partition's links into stars
(`mapInArrow`), and then across partitions, as alternating large-star and small-star rounds (Kiveris
et al., "Connected Components in MapReduce and Beyond", 2014) made of grouped minima and joins.
Links never reach the driver; each round is a work table, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import work

_FLUSH = 500_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > _FLUSH:  # bounded memory: what has been joined so far goes out as stars
            yield stars()
    yield stars()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.withColumnRenamed("m", "v")).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that occurs in a link of two different ids; component is the
    smallest id reachable. Null ends link with nothing; repeated links are harmless."""
    ship(links.sparkSession)
    e = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(f"`{a}` is not null and `{b}` is not null").filter("u <> v")
    e = work.save(e.mapInArrow(_local_stars, "u long, v long").distinct(), "links")
    mark = _mark(e)
    while True:
        turned = work.save(_small_star(_large_star(e)), "links")
        work.drop(e)
        e, seen = turned, mark
        mark = _mark(e)
        if mark == seen:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    out = roots.unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("component"))
    return work.save(out, "components")
