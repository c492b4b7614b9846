"""Typed binary columns: little-endian packs of unsigned 16-bit, signed 32-bit and 32-bit floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

_SPARK = {"<f4": "double", "<i4": "int", "<u2": "int"}


def pack_u16(x: Column) -> Column:
    """Two bytes of a number from 0 to 65535, the low byte first."""
    h = F.lpad(F.hex(x.cast("long")), 4, "0")
    return F.unhex(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))


def u16_at(content: Column, index: Column) -> Column:
    """The number at an index of a pack, without leaving the JVM."""
    byte = lambda k: F.hex(F.substring(content, (index * 2 + k + 1).cast("int"), F.lit(1)))
    return F.conv(F.concat(byte(1), byte(0)), 16, 10).cast("int")


def u16_range(content: Column, start: int, count: int) -> Column:
    """A slice of a pack as an array; null if the pack is too short for it."""
    whole = F.transform(F.sequence(F.lit(start), F.lit(start + count - 1)), lambda i: u16_at(content, i))
    return F.when(F.octet_length(content) >= 2 * (start + count), whole)


def encode(rows: DataFrame, kind: str) -> DataFrame:
    """(key, values array) to (key, shape, content)."""
    ship(rows.sparkSession)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            out = [None if x is None else np.array(x, kind).tobytes() for x in v.to_pylist()]
            shape = [None if x is None else [len(x)] for x in v.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shape, pa.list_(pa.int32())), pa.array(out, pa.binary())], ["key", "shape", "content"])

    return rows.select("key", "values").mapInArrow(turn, f"key {rows.schema['key'].dataType.simpleString()}, shape array<int>, content binary")


def decode(rows: DataFrame, kind: str) -> DataFrame:
    """(key, shape, content) to (key, values). The byte length must be that of the shape, dimensions
    positive and floats finite; else the job fails with the key."""
    ship(rows.sparkSession)
    width = np.dtype(kind).itemsize
    out_kind = pa.float64() if kind == "<f4" else pa.int32()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = []
            for key, shape, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if min(shape) < 1 or len(content) != width * int(np.prod(shape, dtype=np.int64)):
                    raise ValueError(f"tensor {key}: {len(content)} bytes do not fit shape {shape}")
                x = np.frombuffer(content, kind)
                if kind == "<f4" and not np.isfinite(x).all():
                    raise ValueError(f"tensor {key}: not finite")
                values.append(x.astype(np.float64 if kind == "<f4" else np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(out_kind))], ["key", "values"])

    return rows.select("key", "shape", "content").mapInArrow(turn, f"key {rows.schema['key'].dataType.simpleString()}, values array<{_SPARK[kind]}>")
