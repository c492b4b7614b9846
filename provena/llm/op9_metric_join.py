"""Embedding near-duplicates: exact metric range join.

Cosine >= c on unit vectors is a distance of at most r = sqrt(2 - 2c). A sample of vectors serves as
pivots, four times the square root of their number; each vector belongs to the cell of its nearest pivot. A
vector within r of some vector of cell i must satisfy d(y, p_i) <= d(y, p_own) + 2r and d(y, p_i) <= R_i + r
(triangle inequality, R_i the cell's radius) and lie at most r beyond the bisector of p_i and p_own; only
then it is compared with cell i. Every cell finds the links of its own vectors alone, so cells join
independently and no link is lost.

Cells whose pivots lie near each other form a unit, and a vector is copied once to each unit that holds a
cell it is compared with; there it meets those cells only. Units are cut into blocks of at most `BLOCK` own
vectors. A block's own vectors are held in memory, and its candidates pass by in slices, so memory is
bounded whatever the cell's size; a block sends out counts and one label for each linked vector, not its
pairs, and how many pairs it compared. Equal vectors are one class before the join. The number of pivots
does not depend on the cluster; that of units does, since a vector goes once to each. In data without
structure (random directions in 64 dimensions) the bounds leave most pairs, and the work grows with the
square of the distinct vectors; see the README for measured shares.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing
and are their own component; vectors of different lengths never link; repeated rows count as further
vectors of their class; a vector without an id counts for nobody and comes back with no links and
a null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import graph, work
from .bytes_ import column, list_array

#: Most and fewest own vectors of a block, and rows of one product.
BLOCK, SMALL_BLOCK, CHUNK = 16_384, 1_024, 256
#: Pairs that a block and a slice of its candidates have at most, and that may all be links at once.
PAIRS = 1 << 23
#: Candidate slices that one task takes before a block's candidates are dealt to several tasks.
SLICES = 32
#: Pivots: so many times the square root of the distinct vectors, and at most this number (so they fit the driver).
PIVOTS, MOST = 4, 512
_SLACK = 1e-7


def _units(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows and their unit vectors in double precision."""
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
        x = x / np.abs(x).max(1, keepdims=True)  # keeps squares of tiny and huge components finite
        out[d] = rows, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))


def _assigned(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    pivots: dict[int, tuple[int, np.ndarray]] = held.value
    for batch in batches:
        cell, far, width = (np.zeros(batch.num_rows, t) for t in (np.int64, float, np.int64))
        for d, (rows, x) in _units(column(batch, "vector")).items():
            first, p = pivots.get(d, (-d, None))
            width[rows] = d
            if p is None:  # no pivot of this length: one cell
                cell[rows], far[rows] = -d, 2.0
            else:
                dist = _distance(x, p)
                near = dist.argmin(1)
                cell[rows], far[rows] = first + near, dist[np.arange(len(rows)), near]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])


class Cells:
    """Pivots by vector length, with the first cell's number; radii; the unit of each cell."""

    def __init__(self, pivots: dict[int, tuple[int, np.ndarray]], radius: dict[int, float], units: int, r: float):
        self.pivots, self.radius, self.r = pivots, radius, r
        all_ = sum(len(p) for _, p in pivots.values())
        self.unit, self.between = {}, {}
        for d, (first, p) in pivots.items():
            far = self.between[d] = _distance(p, p)
            heads, near = [0], far[0]
            for _ in range(1, min(len(p), -(-units * len(p) // all_))):  # the farthest pivot starts the next unit
                heads.append(int(near.argmax()))
                near = np.minimum(near, far[heads[-1]])
            self.unit[d] = first + np.array(heads)[far[:, heads].argmin(1)]

    def compared(self, d: int, x: np.ndarray, cell: np.ndarray, far: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which rows (of length d, in `cell` at distance `far`) are compared with which `cells`."""
        first, p = self.pivots[d]
        dist, reach = _distance(x, p[cells - first]), np.array([self.radius.get(k, -9.0) for k in cells.tolist()])
        beyond = dist**2 - far[:, None] ** 2 <= 2 * self.r * self.between[d][cell - first][:, cells - first] + _SLACK
        take = (dist <= far[:, None] + 2 * self.r + _SLACK) & (dist <= reach + self.r + _SLACK) & beyond
        return take | (cell[:, None] == cells)


def _copied(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Adds the row's own unit and all units that it goes to."""
    cells: Cells = held.value
    for batch in batches:
        cell, far = (column(batch, c).to_numpy() for c in ("cell", "far"))
        own, units = cell.copy(), [np.array([c]) for c in cell.tolist()]
        for d, (rows, x) in _units(column(batch, "vector")).items():
            if d in cells.pivots:
                first, p = cells.pivots[d]
                unit = cells.unit[d]
                order = np.argsort(unit, kind="stable")
                names, at = np.unique(unit[order], return_index=True)
                take = np.logical_or.reduceat(cells.compared(d, x, cell[rows], far[rows], first + order), at, axis=1)
                own[rows] = unit[cell[rows] - first]
                for i, t in zip(rows.tolist(), take, strict=True):
                    units[i] = names[t]
        at = np.concatenate([[0], np.cumsum([len(u) for u in units])])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), list_array(np.concatenate(units), at, pa.int64())], [*batch.schema.names, "unit", "units"])


class _Rows:
    """Vectors of one length, with what the join needs of them; a block's own ones come sorted by cell."""

    def __init__(self, t: pa.Table, by_cell: bool = False):
        if by_cell:
            t = t.take(pa.array(np.argsort(t.column("cell").to_numpy(), kind="stable")))
        ((self.width, (_, self.x)),) = _units(t.column("vector").combine_chunks()).items()
        self.ids, self.copies, self.cell, self.far = (t.column(c).to_numpy() for c in ("id", "copies", "cell", "far"))
        self.x32 = self.x.astype(np.float32)


def _block(own: _Rows, t: pa.Table, cosine: float, cells: Cells) -> pa.RecordBatch:
    """Links between own vectors and a slice of candidates: (id, linked vectors, smallest id reached), and a row
    without id that holds the number of pairs compared."""
    other = _Rows(t)
    links, pairs = [], 0
    names, first = np.unique(own.cell, return_index=True)
    take = cells.compared(own.width, other.x, other.cell, other.far, names) if own.width in cells.pivots else np.ones((len(other.ids), len(names)), bool)
    for k, (lo, end) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(own.ids)], strict=True)):
        near = np.flatnonzero(take[:, k])
        pairs += len(near) * (end - lo)
        y32 = other.x32 if len(near) > 0.9 * len(take) else other.x32[near]
        if len(near) > 0.9 * len(take):
            near = np.arange(len(take))
        for at in range(lo, end, CHUNK):
            i, j = np.nonzero(own.x32[at : min(end, at + CHUNK)] @ y32.T >= cosine - 1e-4)
            if len(i):
                ri, rj = np.unique(i), np.unique(j)
                exact = own.x[at + ri] @ other.x[near[rj]].T >= cosine
                exact &= own.ids[at + ri][:, None] != other.ids[near[rj]]
                p, q = np.nonzero(exact)
                links.append(np.stack([at + ri[p], near[rj[q]]]).astype(np.int32))
    names_ = ["id", "n", "low"]
    count = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([pairs], pa.int64()), pa.array([None], pa.int64())], names_)
    if not links:
        return count
    i, j = np.concatenate(links, axis=1)
    n = np.bincount(i, other.copies[j], len(own.ids)).astype(np.int64)
    low_a, low_b = own.ids.copy(), other.ids.copy()
    while True:  # smallest label over the block's links
        was = low_a.sum() + low_b.sum()
        np.minimum.at(low_a, i, low_b[j])
        np.minimum.at(low_b, j, low_a[i])
        if low_a.sum() + low_b.sum() == was:
            break
    ua, ub = np.unique(i), np.unique(j)
    found = pa.RecordBatch.from_arrays([pa.array(np.concatenate([own.ids[ua], other.ids[ub]])), pa.array(np.concatenate([n[ua], np.zeros(len(ub), np.int64)])), pa.array(np.concatenate([low_a[ua], low_b[ub]]))], names_)
    return pa.Table.from_batches([count, found]).combine_chunks().to_batches()[0]


def _joined(batches: Iterator[pa.RecordBatch], cosine: float, most: int, held) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its own vectors first; candidates are taken in slices of `most`."""
    key, own, ready, wait = None, [], None, []

    def due() -> pa.RecordBatch:
        nonlocal ready
        ready = ready or _Rows(pa.concat_tables(own), by_cell=True)
        out = _block(ready, pa.concat_tables(wait), cosine, held.value)
        wait.clear()
        return out

    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = np.stack([t.column(c).to_numpy() for c in ("unit", "a", "b", "own")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            *at, mine = keys[:, lo].tolist() if lo < hi else (*(key or ()), 0)
            if lo < hi and at != key:
                if wait and own:
                    yield due()
                wait.clear()
                key, own, ready = at, [], None
            if mine:
                own.append(t.slice(lo, hi - lo))
                continue
            while lo < hi and own:
                step = min(hi - lo, most - sum(w.num_rows for w in wait))
                wait.append(t.slice(lo, step))
                lo += step
                if sum(w.num_rows for w in wait) >= most:
                    yield due()
    if wait and own:
        yield due()


def block_size(count: int, cores: int) -> int:
    """Own vectors of a block: one block for each core, within bounds, as every block more is a copy more
    of each vector."""
    return min(BLOCK, max(SMALL_BLOCK, -(-count // max(1, cores))))


def search(classes: DataFrame, cosine: float) -> DataFrame:
    """(id, n, low): links of distinct vectors (vector, id, copies), added up by blocks: links found, counted
    in copies, and the smallest id that a block's links reach. Rows without an id count the pairs compared."""
    spark = classes.sparkSession
    ship(spark)
    count = classes.count()
    block = block_size(count, spark.sparkContext.defaultParallelism)
    # A bounded sample by a hash of the id: exactly so many rows, or all.
    drawn = classes.orderBy(F.xxhash64("id"), "id").limit(min(MOST, max(2, round(PIVOTS * count**0.5)))).select("vector").toArrow()
    pivots, first = {}, 0
    if drawn.num_rows:
        for d, (_, p) in _units(drawn.column("vector").combine_chunks()).items():
            pivots[d] = (first, p)
            first += len(p)
    held = spark.sparkContext.broadcast(pivots)
    base = "vector array<double>, id long, copies long, cell long, far double"
    placed = work.save(classes.mapInArrow(lambda it: _assigned(it, held), base), "cells")
    radius = {r["cell"]: r["r"] for r in placed.groupBy("cell").agg(F.max("far").alias("r")).collect()}  # one row for each pivot
    cells = spark.sparkContext.broadcast(Cells(pivots, radius, -(-count // block), float(np.sqrt(2 - 2 * cosine))))
    copied = work.save(placed.mapInArrow(lambda it: _copied(it, cells), f"{base}, unit long, units array<long>"), "copies")
    work.drop(placed)
    own = copied.groupBy("unit").agg(F.count("*").alias("own"))
    size = copied.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("all")).join(own, "unit")
    parts = F.broadcast(size.selectExpr("unit", f"cast(ceil(own / {block}) as int) as na", f"cast(ceil(all / {SLICES * block}) as int) as nb"))  # at most one row for each pivot
    row = ["id", "copies", "vector", "cell", "far"]
    left = copied.select(*row, "unit").join(parts, "unit").withColumn("a", F.pmod(F.xxhash64("id"), "na").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = copied.select(*row, F.explode("units").alias("unit")).join(parts, "unit").withColumn("b", F.pmod(F.xxhash64("id"), "nb").cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    blocks = left.withColumn("own", F.lit(1)).unionByName(right.withColumn("own", F.lit(0))).select("unit", "a", "b", "own", *row)
    found = blocks.repartition("unit", "a", "b").sortWithinPartitions("unit", "a", "b", F.desc("own")).mapInArrow(lambda it: _joined(it, cosine, max(1, PAIRS // block), cells), "id long, n long, low long")
    found = work.save(found, "links")
    work.drop(copied)
    return found


def range_join(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept."""
    rows = vectors.selectExpr("cast(vec_id as bigint) as vec_id", "cast(embedding as array<double>) as vector")
    bad = "x -> x is null or isnan(x) or abs(x) = double('infinity')"
    good = rows.filter(f"vec_id is not null and size(vector) > 0 and not exists(vector, {bad}) and exists(vector, x -> x <> 0)")
    classes = work.save(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    found = search(classes, cosine).filter("id is not null")
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = graph.components(found, "id", "low")
    result = classes.join(n, "id", "left").join(group, "id", "left").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component", "vec_id"))
    n_links = F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return rows.join(result, "vector", "left").select("vec_id", n_links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `embeddings`, linked from cosine 0.95."""
    return range_join(table(spark, sf_dir, "embeddings"))
