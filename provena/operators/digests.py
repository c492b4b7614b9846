"""SHA-256 of states that are larger than a row or a task's memory.

A state is all entries of a key in an order. Entries are range-sorted, so a large state is sorted by many tasks. A state that
begins and ends inside one task and is no longer than CHUNK bytes is digested there; the others become chunks, which are
digested one after another. A digest must see its bytes in order, so a long state is cut into links of LINK bytes: each
link is a job of its own that takes up the digest where the link before left it, and no task reads more of a state than that.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

CHUNK, LINK = 4 << 20, 128 << 20


class Sha256:
    """A SHA-256 that can be stored half-way, by OpenSSL's context of fixed size, which holds no pointers."""

    SIZE = 112

    def __init__(self, state: bytes | None = None):
        self.lib, self.context = self.library(), ctypes.create_string_buffer(state, self.SIZE) if state else ctypes.create_string_buffer(self.SIZE)
        if not state:
            self.lib.SHA256_Init(self.context)

    @staticmethod
    def library() -> ctypes.CDLL | None:
        """The library that Python's own hashlib calls, if it has these functions."""
        try:
            import _hashlib

            lib = ctypes.CDLL(_hashlib.__file__)
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            return lib if lib.SHA256_Init and lib.SHA256_Final else None
        except (ImportError, OSError, AttributeError):
            return None

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, len(data))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.context)
        return out.raw.hex()


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """The rows at which another key begins."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for i in range(keys):
        code = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch], keys: int, tail: int, names: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key and order, each with a separator of `tail` bytes after it, to (keys, part, seq, n, bytes, data, sha):
    chunks, or digests of the states that are known to be whole."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    own, held, n, size, alone = None, [], 0, 0, False  # alone: nothing of this key is in another row

    def out(cols: list[pa.Array], n: list, sizes: list, data: list, sha: list) -> pa.RecordBatch:
        nonlocal seq
        at = pa.array(np.arange(seq, seq + len(n)))
        seq += len(n)
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(n), part)), at, pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()), pa.array(sha, pa.string())], names)

    def flush(whole: bool) -> pa.RecordBatch:
        data = b"".join(held)
        data = data[: len(data) - tail]
        sha = hashlib.sha256(data).hexdigest() if whole and digest else None
        return out(own, [n], [len(data)], [None if sha else data], [sha])

    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(keys)
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        raw = memoryview(col.buffers()[2] or b"")
        starts = _starts(b, keys)
        ends = np.append(starts[1:], b.num_rows)
        same = own is not None and all(x.equals(b.column(i).slice(0, 1)) for i, x in enumerate(own))
        if own is not None and not same:
            yield flush(alone)
        lo = 0 if same else None
        if digest and len(starts) > 2:  # those in the middle begin and end here
            mid = slice(1, -1)
            small = np.all(off[ends[mid]] - off[starts[mid]] <= CHUNK)
        else:
            small = False
        runs = range(len(starts))
        for r in runs:
            if small and 0 < r < len(starts) - 1:
                if r == 1:
                    s, e = starts[1:-1], ends[1:-1]
                    at = [(x, y - tail) for x, y in zip(off[s].tolist(), off[e].tolist(), strict=True)]
                    yield out([b.column(i).take(pa.array(s)) for i in range(keys)], (e - s).tolist(), [y - x for x, y in at], [None] * len(at), [hashlib.sha256(raw[x:y]).hexdigest() for x, y in at])
                continue
            s, e = int(starts[r]), int(ends[r])
            if r or not same:
                alone = own is not None  # the first key of a task may have begun in another
                own, held, n, size = [b.column(i).slice(s, 1) for i in range(keys)], [], 0, 0
            while s < e:
                if size >= CHUNK:
                    yield flush(False)
                    held, n, size, alone = [], 0, 0, False
                k = max(s + 1, min(e, int(np.searchsorted(off[: e + 1], off[s] + CHUNK - size, "left"))))
                held.append(bytes(raw[off[s] : off[k]]))
                n, size, s = n + k - s, size + int(off[k] - off[s]), k
            if r < len(starts) - 1:
                yield flush(alone)
    if own is not None:
        yield flush(False)


def _resumed(batches: Iterator[pa.RecordBatch], keys: int, separator: bytes, names: list[str], links: bool) -> Iterator[pa.RecordBatch]:
    """States so far (rows with `state`) and the chunks after them, sorted by key, part and seq, to (keys, n, bytes, state, sha):
    the digest where the last chunk is there, else the state."""
    own, h, n, size, ended, done = None, None, 0, 0, False, []

    def rows() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        done.clear()
        heads = [pa.concat_arrays(c) for c in cols[:keys]]
        return pa.RecordBatch.from_arrays([*heads, *(pa.array(c, k) for c, k in zip(cols[keys:], (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], names)

    def end() -> None:
        done.append((*own, n, size, None if ended else h.state(), h.hexdigest() if ended else None))

    for b in batches:
        for i in range(b.num_rows):
            key = [b.column(k).slice(i, 1) for k in range(keys)]
            more, length, data, state, last = (b.column(keys + k)[i] for k in range(5))
            if h is None or not all(x.equals(y) for x, y in zip(own, key, strict=True)):
                if h:
                    end()
                own, h, n, size = key, (Sha256(state.as_py()) if links else hashlib.sha256()), 0, 0
            elif separator:
                h.update(separator)
                size += len(separator)
            if not state.is_valid:
                h.update(data.as_py())
            n, size, ended = n + more.as_py(), size + length.as_py(), last.as_py()
        if len(done) >= 1000:
            yield rows()
    if h:
        end()
        yield rows()


def _sorted(entries: DataFrame, keys: list[str], order: list[str], data: Column, separator: bytes, digest: bool) -> DataFrame:
    ship(entries.sparkSession)
    named = entries.select(*keys, *(F.col(o).alias(f"order_{i}") for i, o in enumerate(order)), data.cast("binary").alias("data")).filter("data is not null")
    by = [*keys, *(f"order_{i}" for i in range(len(order))), "data"]
    types = "".join(f"{k} {named.schema[k].dataType.simpleString()}, " for k in keys)
    rows = named.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, F.concat("data", F.lit(separator)).alias("data") if separator else F.col("data"))
    names = [*keys, "part", "seq", "n", "bytes", "data", "sha"]
    return rows.mapInArrow(lambda it: _pieces(it, len(keys), len(separator), names, digest), f"{types}part long, seq long, n long, bytes long, data binary, sha string")


def chunks(entries: DataFrame, keys: list[str], order: list[str], data: Column, separator: bytes = b"") -> DataFrame:
    """(keys, part, seq, n, data): each key's entries in order (of equal ones, by their bytes), joined with a separator into
    chunks that follow each other by part and seq. Entries without data are left out."""
    return _sorted(entries, keys, order, data, separator, False).select(*keys, "part", "seq", "n", "data")


def ordered(entries: DataFrame, keys: list[str], order: list[str], data: Column, separator: bytes = b"") -> DataFrame:
    """(keys, n, bytes, sha): the digest of each key's entries in order (of equal ones, by their bytes), with a
    separator between them. Without keys all entries are one state. Entries without data are left out."""
    from ..sources import shared

    spark = entries.sparkSession
    pieces = _sorted(entries, keys, order, data, separator, True)
    types = "".join(f"{k} {pieces.schema[k].dataType.simpleString()}, " for k in keys)

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        path = shared.folder(spark, name)
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pieces = kept(pieces, "pieces")
    whole, open_ = pieces.filter("sha is not null").select(*keys, "n", "bytes", "sha"), pieces.filter("sha is null").drop("sha")
    own = Window.partitionBy(*keys, F.lit(0)).orderBy("part", "seq")  # over chunks' lengths, not their bytes
    before = F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, -1))
    links = Sha256.library() is not None
    link = F.floor(F.coalesce(before, F.lit(0)) / LINK).cast("int") if links else F.lit(0)
    at = open_.select(*keys, "part", "seq", "bytes").select("part", "seq", link.alias("link"), F.lead("seq").over(own).isNull().alias("last"))
    linked = kept(open_.join(at, ["part", "seq"]), "links", "link")
    count = (linked.agg(F.max("link")).first()[0] or 0) + 1
    names = [*keys, "n", "bytes", "state", "sha"]
    fields, state = ["n", "bytes", "data", "state", "last"], None
    done = [whole]
    for k in range(count):
        rows = linked.filter(F.col("link") == k).drop("link").withColumn("state", F.lit(None).cast("binary"))
        if state is not None:
            rows = rows.unionByName(state.select(*keys, F.lit(-1).alias("part"), F.lit(-1).alias("seq"), "n", "bytes", F.lit(None).cast("binary").alias("data"), "state", F.lit(False).alias("last")))
        dealt = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "part", "seq").select(*keys, *fields)
        out = dealt.mapInArrow(lambda it: _resumed(it, len(keys), separator, names, links), f"{types}n long, bytes long, state binary, sha string")
        if count > 1:
            out = kept(out, "states")
        done.append(out.filter("sha is not null").select(*keys, "n", "bytes", "sha"))
        state = out.filter("sha is null")
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def little(x: Column, width: int) -> Column:
    """A number's little-endian bytes."""
    h = F.lpad(F.hex(x.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in range(2 * width - 1, 0, -2))))


def tensor_entry(name: Column, kind: Column, shape: Column, content: Column) -> Column:
    """A tensor's bytes in a state's digest: name, kind, number of dimensions (4 bytes), dimensions (8 bytes each), values."""
    sizes = F.aggregate(F.transform(shape, lambda s: little(s, 8)), F.lit(b"").cast("binary"), lambda a, e: F.concat(a, e))
    return F.concat(name.cast("binary"), kind.cast("binary"), little(F.size(shape), 4), sizes, content)
