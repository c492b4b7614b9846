"""ZIP archives as tables: a data source that reads parts of archives, and a sink.

The source reads each archive's central directory first and makes tasks of ranges of its entries, so one large archive
is read by many tasks; a large entry that is stored without compression is split by its bytes as well. Conditions on
`path` decide which entries are read at all. Entries stream through memory in chunks. Entries that would leave the
archive's root, encrypted ones and unknown compressions fail the job, as do contents whose CRC-32 differs where one
task reads the whole entry.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..session import ship
from . import ranges

ENTRY = "archive string, path string, length long, content binary"
PART = "archive string, path string, length long, start long, content binary"


def _inside(name: str) -> str:
    path = posixpath.normpath(name)
    if not name or path.startswith(("/", "..")):
        raise ValueError(f"entry leaves the archive: {name!r}")
    return path


@dataclass
class Entries(InputPartition):
    """Entries of one archive: (path, header offset, method, packed size, size, CRC-32, first byte, last byte)."""

    archive: str
    entries: list[tuple]


def directory(uri: str) -> list[zipfile.ZipInfo]:
    """An archive's entries, from its central directory alone."""
    fs, path = ranges.opened(uri)
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        found = [e for e in z.infolist() if not e.is_dir()]
    for e in found:
        _inside(e.filename)
        if e.flag_bits & 1:
            raise ValueError(f"entry is encrypted: {e.filename!r}")
        if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"entry has an unknown compression: {e.filename!r}")
    return found


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.whole = options.get("whole", "false").lower() == "true"
        self.task = int(options.get("taskbytes", ranges.TASK))
        self.chunk = int(options.get("chunkbytes", ranges.CHUNK))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("path",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        rule = {"is": lambda v: path == v, "in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith}
        return all(rule[k](v) for k, v in self.tests)

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri in ranges.listed(self.path, (".zip",)):
            own, size = [], 0
            for e in directory(uri):
                path = _inside(e.filename)
                if not self._wanted(path):
                    continue
                entry = (path, e.header_offset, e.compress_type, e.compress_size, e.file_size, e.CRC)
                if e.compress_type == zipfile.ZIP_STORED and not self.whole and e.file_size > self.task:
                    step = self.task // self.chunk * self.chunk or self.chunk  # parts begin where chunks do
                    out += [Entries(uri, [(*entry, lo, min(lo + step, e.file_size))]) for lo in range(0, e.file_size, step)]
                    continue
                if own and size + e.compress_size > self.task:
                    out.append(Entries(uri, own))
                    own, size = [], 0
                own.append((*entry, 0, e.file_size))
                size += e.compress_size
            if own:
                out.append(Entries(uri, own))
        return out or [Entries("", [])]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if not partition.entries:
            return
        fs, path = ranges.opened(partition.archive)
        with fs.open_input_file(path) as f:
            for name, header, method, packed, size, crc, lo, hi in partition.entries:
                f.seek(header)
                fixed = f.read(30)
                if fixed[:4] != b"PK\x03\x04":
                    raise ValueError(f"no entry where the directory says: {name!r}")
                data = header + 30 + sum(struct.unpack("<HH", fixed[26:30]))
                if method == zipfile.ZIP_STORED:
                    parts = ranges.read(f, data + lo, hi - lo)
                else:
                    parts = ranges.inflated(ranges.read(f, data, packed))
                yield from self._rows(partition.archive, name, size, crc, lo, hi, parts)

    def _rows(self, archive: str, name: str, size: int, crc: int, lo: int, hi: int, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        seen, start = 0, lo
        pieces = [b"".join(parts)] if self.whole else ranges.regrouped(parts, self.chunk)
        some = False
        for piece in pieces:
            some, seen = True, zlib.crc32(piece, seen)
            yield self._row(archive, name, size, start, piece)
            start += len(piece)
        if not some:
            yield self._row(archive, name, size, lo, b"")
        if start != hi or (lo == 0 and hi == size and seen != crc):
            raise ValueError(f"entry is damaged: {name!r}")

    def _row(self, archive: str, name: str, size: int, start: int, piece: bytes) -> pa.RecordBatch:
        cols = [pa.array([archive]), pa.array([name]), pa.array([size], pa.int64()), *([] if self.whole else [pa.array([start], pa.int64())]), pa.array([piece], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["archive", "path", "length", *([] if self.whole else ["start"]), "content"])


class ZipSource(DataSource):
    """Options: `whole` (one row for each entry, which must fit a row), else chunks of `chunkbytes`; `taskbytes`."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRY if self.options.get("whole", "false").lower() == "true" else PART

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_entries").options(**options).load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of each archive at `path`; directories are skipped."""
    return _load(spark, path, whole="true")


def chunks(spark: SparkSession, path: str, task_bytes: int = ranges.TASK, chunk_bytes: int = ranges.CHUNK) -> DataFrame:
    """(archive, path, length, start, content): entries in chunks, whatever their size."""
    return _load(spark, path, taskbytes=str(task_bytes), chunkbytes=str(chunk_bytes))


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by archive and path: each archive is one stream to a file of its own name for
    this attempt, renamed when it is whole, so a lost or repeated task leaves no part behind."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    open_: tuple | None = None

    def close() -> pa.RecordBatch:
        name, part, stream, z, n = open_
        z.close()
        stream.close()
        fs.move(part, f"{base}/{name}.zip")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "entries"])

    for b in batches:
        for name, path, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if open_ is not None and open_[0] != name:
                yield close()
                open_ = None
            if open_ is None:
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                stream = fs.open_output_stream(part)
                open_ = (name, part, stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0)
            open_[3].writestr(zipfile.ZipInfo(_inside(path)), content)
            open_ = (*open_[:4], open_[4] + 1)
    if open_ is not None:
        yield close()


def write(entries: DataFrame, path: str) -> DataFrame:
    """(archive, path, content) rows to one ZIP each, written by the tasks into a folder that they share
    (any store that pyarrow opens). Entries are stored without compression, in the order of their paths,
    and pass through memory one at a time. Returns (archive, entries)."""
    spark = entries.sparkSession
    ship(spark)
    folder = path if "://" in path else f"file://{path}"
    sorted_ = entries.select(F.col("archive").cast("string"), "path", F.col("content").cast("binary")).repartition("archive").sortWithinPartitions("archive", "path")
    done = f"{path.rstrip('/')}-written-{uuid.uuid4().hex}"
    sorted_.mapInArrow(lambda it: _written(it, folder), "archive string, entries long").write.parquet(done)
    return spark.read.schema("archive string, entries long").parquet(done)
