"""Vectorised views of Arrow text columns.

Every text operator of this package walks its texts through these helpers: a batch of strings is one
byte buffer with offsets, and words, lines and their hashes are index arrays over it. Nothing here
loops over rows or characters in Python, and one slice holds a megabyte of text (or one longer text) and
a few thousand rows, so memory is bounded by the longest text. A worker gives its free memory back when a
task ends, as idle workers stay while later stages run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _tables(fold: bool) -> np.ndarray:
    """64 x 256 random words: position in the word, byte. Folding gives A-Z the values of a-z."""
    t = np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**64, (64, 256), dtype=np.uint64)
    if fold:
        t[:, 65:91] = t[:, 97:123]
    return t.ravel()


_TAB = {False: _tables(False), True: _tables(True)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string array; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple]:
    """(record batch, bytes, offsets) of at most `most` bytes of text and SLICE_ROWS rows each, or of one
    longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, off = buffers(batch.column(batch.schema.get_field_index(text)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, min(lo + SLICE_ROWS, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
            yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: byte starts and ends, and `first`, the n + 1 offsets
    of each text's words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        solid = ~_SPACE[buf]
        before = np.empty(len(buf) + 1, bool)  # before[i]: a word may start at i
        before[0] = True
        before[1:] = ~solid
        before[off] = True
        self.buf, self.solid = buf, solid
        self.starts = np.flatnonzero(solid & before[:-1])
        after = np.empty(len(buf) + 1, bool)  # after[i]: a word may end before i
        after[:-1] = ~solid
        after[-1] = True
        after[off] = True
        self.ends = np.flatnonzero(solid & after[1:]) + 1
        self.first = np.searchsorted(self.starts, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word (tabulation by position and byte)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return segment_hashes(self.buf[self.solid], self.ends - self.starts, fold)


def segment_hashes(data: np.ndarray, sizes: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the adjoining segments (of at least one byte) that make up `data`."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    at = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=at[1:])
    pos = np.arange(len(data), dtype=np.int32) - np.repeat(at.astype(np.int32), sizes)
    cell = ((pos & 63) << 8) | data
    value = _TAB[fold][cell]
    if sizes.max() > 64:
        value *= ((pos >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)) + np.uint64(1)
    return mix(np.add.reduceat(value, at) + sizes.astype(np.uint64))


def digests(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each whole text."""
    size = np.diff(off)
    some = np.flatnonzero(size)
    out = np.zeros((2, len(size)), np.uint64)
    if len(some):
        pos = np.arange(len(buf), dtype=np.int64) - np.repeat(off[:-1], size)
        value = _TAB[False][((pos & 63) << 8) | buf] * ((pos >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1))
        out[0, some] = np.add.reduceat(value, off[some])
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        out[1, some] = np.add.reduceat(value, off[some])
    return tuple(mix(x + size.astype(np.uint64)).view(np.int64) for x in out)


def totals(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of `mask` over each text."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars]] = True
    return out


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words that lie in one text, and the index of their first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) % 2**64 | 1)
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    ok = np.ones(n, bool)
    for i in range(1, size):  # windows that would cross into a later text
        cut = first[1:-1] - i
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
