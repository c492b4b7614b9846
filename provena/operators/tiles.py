"""Matrices as tables of tiles, and products of them that neither broadcast nor explode a factor.

A tile is a row (i, j, h, w, data): block row, block column, height, width, and the values as little-endian
doubles, row after row. Products join tiles on the inner block and add up the partial tiles, first inside each
task and then by (i, j), so a shuffle carries tiles and a task holds a few of them. Where few inner blocks
meet many tiles (a tall matrix against a small weight), both sides are dealt over salts: the tall one by its
block row, the other copied to each salt, so no inner block is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

TILE = "i long, j long, h int, w int, data binary"
_NAMES = ["i", "j", "h", "w", "data"]
#: Tiles of the tall factor that one salt of an inner block takes, and partial sums that a task holds.
EACH, HELD = 256, 64


def _array(row: dict, at: str = "") -> np.ndarray:
    return np.frombuffer(row[f"{at}data"], "<f8").reshape(row[f"{at}h"], row[f"{at}w"])


def _batch(tiles: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    cols = [[t[0] for t in tiles], [t[1] for t in tiles], [t[2].shape[0] for t in tiles], [t[2].shape[1] for t in tiles], [np.ascontiguousarray(t[2], "<f8").tobytes() for t in tiles]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], _NAMES)


def each(rows: DataFrame, kernel: Callable[[dict], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """Tiles that a numpy kernel makes of each row (a few tiles side by side)."""
    ship(rows.sparkSession)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                if made := [t for row in b.slice(lo, 16).to_pylist() for t in kernel(row)]:
                    yield _batch(made)
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks

    return rows.mapInArrow(turn, TILE)


def beside(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Two matrices' tiles in one row, those of the right one as r_h, r_w, r_data (and r_i or r_j)."""
    on = on or ["i", "j"]
    return left.join(right.select(*on, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in on)), on)


def map_tiles(x: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    return each(x, lambda r: [(r["i"], r["j"], f(_array(r)))])


def zip_tiles(x: DataFrame, y: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    return each(beside(x, y), lambda r: [(r["i"], r["j"], f(_array(r), _array(r, "r_")))])


def with_rows(x: DataFrame, row: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """f(tile, what `row` holds for its block row), where `row` is one tile (i, 0) of a few columns."""
    return each(beside(x, row.drop("j"), ["i"]), lambda r: [(r["i"], r["j"], f(_array(r), _array(r, "r_")))])


def _itself(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    yield row["i"], row["j"], _array(row)


def merge(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], kernel: Callable[[dict], Iterator[tuple[int, int, np.ndarray]]] = _itself) -> DataFrame:
    """One tile for each (i, j): an associative f over all tiles that a kernel makes of each row, first inside each
    task. A task makes and merges them in one Python worker, holds HELD partial tiles at most and sends them on when
    it has that many."""
    ship(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                for i, j, x in (t for row in b.slice(lo, 16).to_pylist() for t in kernel(row)):
                    key = (i, j)
                    held[key] = f(held[key], x) if key in held else x
                    if len(held) > HELD:
                        yield _batch([(*k, v) for k, v in held.items()])
                        held.clear()
        if held:
            yield _batch([(*k, v) for k, v in held.items()])
        pa.default_memory_pool().release_unused()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sum_ = None, None
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                done = []
                for r in b.slice(lo, 16).to_pylist():
                    own, x = (r["i"], r["j"]), _array(r)
                    if own == key:
                        sum_ = f(sum_, x)
                    else:
                        if key:
                            done.append((*key, sum_))
                        key, sum_ = own, x
                if done:
                    yield _batch(done)
        if key:
            yield _batch([(*key, sum_)])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(partial, TILE).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(whole, TILE)


def add_up(rows: DataFrame, kernel: Callable[[dict], Iterator[tuple[int, int, np.ndarray]]] = _itself) -> DataFrame:
    return merge(rows, lambda a, b: a + b, kernel)


def _salts(tall: DataFrame, inner: str) -> int:
    """So that an inner block's tiles come in groups of about EACH."""
    most = tall.groupBy(inner).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return -(-most // EACH)


def _joined(left: DataFrame, right: DataFrame, inner: tuple[str, str], by: str) -> DataFrame:
    """Left tiles beside right ones of the same inner block, salted by the left one's `by`."""
    salts = _salts(left, inner[0])
    a = left.withColumn("inner", F.col(inner[0])).withColumn("salt", F.pmod(by, F.lit(salts)))
    b = right.select(F.col(inner[1]).alias("inner"), *(F.col(c).alias(f"r_{c}") for c in _NAMES)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, ["inner", "salt"])


def product_nt(x: DataFrame, w: DataFrame) -> DataFrame:
    """X W^T: x is (i, j), w is (o, j)."""
    return add_up(_joined(x, w, ("j", "j"), "i"), lambda r: [(r["i"], r["r_i"], _array(r) @ _array(r, "r_").T)])


def product_nn(x: DataFrame, w: DataFrame) -> DataFrame:
    """X W: x is (i, o), w is (o, j)."""
    return add_up(_joined(x, w, ("j", "i"), "i"), lambda r: [(r["i"], r["r_j"], _array(r) @ _array(r, "r_"))])


def product_tn(x: DataFrame, y: DataFrame) -> DataFrame:
    """X^T Y: x is (i, o), y is (i, j); the sum runs over the block rows."""
    return add_up(beside(x, y, ["i"]), lambda r: [(r["j"], r["r_j"], _array(r).T @ _array(r, "r_"))])


def from_rows(rows: DataFrame, key: str, vec: str, height: int, width: int) -> DataFrame:
    """Tiles of rows that are numbered from 0 without gaps and hold arrays of one length; a gap or another length
    fails the job."""
    named = rows.select(F.col(key).cast("long").alias("r"), F.transform(vec, lambda v: v.cast("double")).alias("vec"))
    groups = named.groupBy(F.floor(F.col("r") / height).cast("long").alias("i")).agg(F.array_sort(F.collect_list(F.struct("r", "vec"))).alias("rows"))  # at most `height` rows

    def cut(r: dict) -> Iterator[tuple[int, int, np.ndarray]]:
        if [x["r"] for x in r["rows"]] != list(range(r["i"] * height, r["i"] * height + len(r["rows"]))):
            raise ValueError(f"rows of block {r['i']} have gaps or occur twice")
        x = np.array([x["vec"] for x in r["rows"]], "<f8")
        yield from ((r["i"], j, x[:, lo : lo + width]) for j, lo in enumerate(range(0, x.shape[1], width)))

    return each(groups, cut)


def from_rule(like: DataFrame, rows: int, cols: int, height: int, width: int, rule: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A matrix whose entries follow a rule of row and column; each tile is made by a task."""
    spark = like.sparkSession
    across = -(-cols // width)
    at = spark.range(-(-rows // height) * across).select(F.floor(F.col("id") / across).cast("long").alias("i"), (F.col("id") % across).alias("j"))

    def made(r: dict) -> Iterator[tuple[int, int, np.ndarray]]:
        o, c = np.arange(r["i"] * height, min(rows, (r["i"] + 1) * height)), np.arange(r["j"] * width, min(cols, (r["j"] + 1) * width))
        yield r["i"], r["j"], rule(o[:, None].astype(float), c[None, :].astype(float))

    return each(at, made)


def to_long(x: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, x) of every value, for comparison and small results."""
    ship(x.sparkSession)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in (t for lo in range(0, b.num_rows, 16) for t in b.slice(lo, 16).to_pylist()):
                v = _array(t)
                r, c = np.indices(v.shape)
                yield pa.RecordBatch.from_arrays([pa.array((t["i"] * height + r).ravel()), pa.array((t["j"] * width + c).ravel()), pa.array(v.ravel())], ["r", "c", "x"])

    return x.mapInArrow(turn, "r long, c long, x double")
