"""Tensor checkpoints as a table: one row for each tensor, read without running what the file says.

A checkpoint is a ZIP archive with a pickled description (`<root>/data.pkl`) and one stored entry for each storage
(`<root>/data/<key>`). The description is walked opcode by opcode: plain values, dictionaries, lists, tuples and the
few names that tensors need are rebuilt as data; any other name, call or opcode fails the job. Tensors then become byte
ranges of their storages, which tasks read side by side.
"""

from __future__ import annotations

import math
import pickletools
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from . import ranges

TENSORS = "checkpoint string, name string, shape array<long>, kind string, length long, content binary"
VALUES = "checkpoint string, name string, value string"

# Element kinds of storages of the public checkpoint format, with bytes an element.
STORAGES = {
    "DoubleStorage": ("f64", 8),
    "FloatStorage": ("f32", 4),
    "HalfStorage": ("f16", 2),
    "BFloat16Storage": ("bf16", 2),
    "LongStorage": ("i64", 8),
    "IntStorage": ("i32", 4),
    "ShortStorage": ("i16", 2),
    "CharStorage": ("i8", 1),
    "ByteStorage": ("u8", 1),
    "BoolStorage": ("bool", 1),
}
# The other names that a description may hold.
TENSOR, PARAMETER, ORDERED = "torch._utils._rebuild_tensor_v2", "torch._utils._rebuild_parameter", "collections.OrderedDict"


@dataclass(frozen=True)
class Name:
    text: str


@dataclass
class Storage:
    kind: str
    width: int
    key: str
    size: int


@dataclass
class Tensor:
    storage: Storage
    offset: int
    shape: tuple
    stride: tuple


class Refused(ValueError):
    """The description holds something that a checkpoint of tensors does not need."""


def _name(module: str, attribute: str) -> Name:
    text = f"{module}.{attribute}"
    if text in (TENSOR, PARAMETER, ORDERED) or (module == "torch" and attribute in STORAGES):
        return Name(text)
    raise Refused(f"name refused: {text}")


def _called(f: object, args: tuple) -> object:
    if f == Name(ORDERED) and (args == () or (len(args) == 1 and isinstance(args[0], list))):
        return {k: v for k, v in (args[0] if args else [])}
    if f == Name(TENSOR) and len(args) >= 4 and isinstance(args[0], Storage):
        storage, offset, shape, stride = args[:4]
        numbers = isinstance(shape, tuple) and isinstance(stride, tuple) and len(shape) == len(stride) and all(type(x) is int and x >= 0 for x in (offset, *shape, *stride))
        if not numbers or (0 not in shape and offset + sum((n - 1) * s for n, s in zip(shape, stride, strict=True)) >= storage.size):
            raise Refused("tensor outside its storage")
        return Tensor(storage, offset, shape, stride)
    if f == Name(PARAMETER) and args and isinstance(args[0], Tensor):
        return args[0]
    raise Refused(f"call refused: {f}")


def _stored(pid: object) -> Storage:
    if isinstance(pid, tuple) and len(pid) == 5 and pid[0] == "storage" and isinstance(pid[1], Name) and type(pid[4]) is int and isinstance(pid[2], str):
        kind, width = STORAGES.get(pid[1].text.removeprefix("torch."), (None, 0))
        if kind and posixpath.basename(pid[2]) == pid[2]:
            return Storage(kind, width, pid[2], pid[4])
    raise Refused("storage refused")


@dataclass
class Description:
    """A stack machine over the opcodes that descriptions of tensors use."""

    stack: list = field(default_factory=list)
    marks: list = field(default_factory=list)
    memo: dict = field(default_factory=dict)

    def _since_mark(self) -> list:
        at = self.marks.pop()
        out, self.stack[at:] = self.stack[at:], []
        return out

    def _put(self, target: object, items: list) -> None:
        if not isinstance(target, dict) or len(items) % 2:
            raise Refused("entries of something that is no dictionary")
        for k, v in zip(items[::2], items[1::2], strict=True):
            if not isinstance(k, (str, int)):
                raise Refused("a key that is neither text nor number")
            target[k] = v

    def run(self, raw: bytes) -> object:
        s = self.stack
        for op, arg, _ in pickletools.genops(raw):
            match op.name:
                case "PROTO" | "FRAME":
                    pass
                case "MARK":
                    self.marks.append(len(s))
                case "NONE" | "NEWTRUE" | "NEWFALSE":
                    s.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[op.name])
                case "BININT" | "BININT1" | "BININT2" | "LONG1" | "BINFLOAT" | "BINUNICODE" | "SHORT_BINUNICODE" | "BINUNICODE8":
                    s.append(arg)
                case "EMPTY_DICT" | "EMPTY_LIST" | "EMPTY_TUPLE":
                    s.append({"EMPTY_DICT": dict, "EMPTY_LIST": list, "EMPTY_TUPLE": tuple}[op.name]())
                case "TUPLE":
                    s.append(tuple(self._since_mark()))
                case "TUPLE1" | "TUPLE2" | "TUPLE3":
                    n = int(op.name[-1])
                    s[-n:] = [tuple(s[-n:])]
                case "APPEND" | "APPENDS":
                    items = [s.pop()] if op.name == "APPEND" else self._since_mark()
                    if not isinstance(s[-1], list):
                        raise Refused("items of something that is no list")
                    s[-1].extend(items)
                case "SETITEM" | "SETITEMS":
                    items = [s.pop() for _ in range(2)][::-1] if op.name == "SETITEM" else self._since_mark()
                    self._put(s[-1], items)
                case "BINPUT" | "LONG_BINPUT":
                    self.memo[arg] = s[-1]
                case "MEMOIZE":
                    self.memo[len(self.memo)] = s[-1]
                case "BINGET" | "LONG_BINGET":
                    s.append(self.memo[arg])
                case "GLOBAL":
                    s.append(_name(*arg.split(" ", 1)))
                case "STACK_GLOBAL":
                    attribute, module = s.pop(), s.pop()
                    s.append(_name(str(module), str(attribute)))
                case "BINPERSID":
                    s.append(_stored(s.pop()))
                case "REDUCE":
                    args = s.pop()
                    s.append(_called(s.pop(), args if isinstance(args, tuple) else (None,)))
                case "BUILD":  # attributes of an ordered dictionary (its metadata) carry no tensor
                    if not isinstance(s.pop(), dict) or not isinstance(s[-1], dict):
                        raise Refused("state of something that is no dictionary")
                case "STOP":
                    if len(s) != 1 or self.marks:
                        raise Refused("the description does not end where it should")
                    return s.pop()
                case _:
                    raise Refused(f"opcode refused: {op.name}")
        raise Refused("the description has no end")


def leaves(x: object, at: str = "") -> Iterator[tuple[str, object]]:
    """(dotted name, tensor or plain value) of nested dictionaries, lists and tuples."""
    pairs = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, (list, tuple)) else None
    if pairs is None:
        yield at, x
    else:
        for k, v in pairs:
            yield from leaves(v, f"{at}.{k}" if at else str(k))


def described(uri: str) -> tuple[list[tuple[str, object]], dict[str, tuple[int, int]]]:
    """A checkpoint's leaves, and where each storage lies in the file (header offset, bytes)."""
    fs, path = ranges.opened(uri)
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        own = [e for e in z.infolist() if posixpath.basename(e.filename) == "data.pkl"]
        if len(own) != 1:
            raise Refused("a checkpoint has one description")
        root = posixpath.dirname(own[0].filename)
        found = list(leaves(Description().run(z.read(own[0]))))
        at = {}
        for e in z.infolist():
            if posixpath.dirname(e.filename) == posixpath.join(root, "data"):
                if e.compress_type != zipfile.ZIP_STORED:
                    raise Refused("storages are not compressed")
                at[posixpath.basename(e.filename)] = (e.header_offset, e.file_size)
    for name, x in found:
        if isinstance(x, Tensor) and at.get(x.storage.key, (0, -1))[1] < x.storage.size * x.storage.width:
            raise Refused(f"storage of {name} is missing or short")
    return found, at


@dataclass
class Some(InputPartition):
    """Tensors of one checkpoint, each with the header offset of its storage."""

    uri: str
    tensors: list[tuple[str, Tensor, int]]


class CheckpointReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.values, self.task = options["path"], options.get("values", "false").lower() == "true", int(options.get("taskbytes", ranges.TASK))

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri in ranges.listed(self.path, (".pt", ".pth", ".ckpt")):
            if self.values:
                out.append(Some(uri, []))
                continue
            found, at = described(uri)
            own, size = [], 0
            for name, x in found:
                if isinstance(x, Tensor):
                    n = math.prod(x.shape) * x.storage.width
                    if own and size + n > self.task:
                        out.append(Some(uri, own))
                        own, size = [], 0
                    own.append((name, x, at[x.storage.key][0]))
                    size += n
            if own:
                out.append(Some(uri, own))
        return out or [Some("", [])]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        if self.values and partition.uri:
            plain = [(n, x) for n, x in described(partition.uri)[0] if not isinstance(x, Tensor)]
            text = [None if x is None else str(x).lower() if isinstance(x, bool) else str(x) for _, x in plain]
            yield pa.RecordBatch.from_arrays([pa.array([partition.uri] * len(plain), pa.string()), pa.array([n for n, _ in plain], pa.string()), pa.array(text, pa.string())], ["checkpoint", "name", "value"])
            return
        if not partition.tensors:
            return
        fs, path = ranges.opened(partition.uri)
        with fs.open_input_file(path) as f:
            for name, x, header in partition.tensors:
                f.seek(header)
                fixed = f.read(30)
                data = header + 30 + sum(struct.unpack("<HH", fixed[26:30]))
                content = self._content(f, data, x)
                yield pa.RecordBatch.from_arrays([pa.array([partition.uri]), pa.array([name]), pa.array([list(x.shape)], pa.list_(pa.int64())), pa.array([x.storage.kind]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], ["checkpoint", "name", "shape", "kind", "length", "content"])

    def _content(self, f, data: int, x: Tensor) -> bytes:
        """The tensor's values, row after row; other strides are gathered from the range that they span."""
        width, n = x.storage.width, math.prod(x.shape)
        if not n:
            return b""
        last = sum((k - 1) * s for k, s in zip(x.shape, x.stride, strict=True))
        raw = b"".join(ranges.read(f, data + x.offset * width, (last + 1) * width))
        dense = [math.prod(x.shape[i + 1 :]) for i in range(len(x.shape))]
        if all(s == d or k == 1 for s, d, k in zip(x.stride, dense, x.shape, strict=True)):
            return raw[: n * width]
        return np.lib.stride_tricks.as_strided(np.frombuffer(raw, f"V{width}"), x.shape, [s * width for s in x.stride]).tobytes()


class CheckpointSource(DataSource):
    """Options: `values` (the plain values instead of the tensors), `taskbytes`."""

    @classmethod
    def name(cls) -> str:
        return "tensor_checkpoint"

    def schema(self) -> str:
        return VALUES if self.options.get("values", "false").lower() == "true" else TENSORS

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(dict(self.options))


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(CheckpointSource)
    return spark.read.format("tensor_checkpoint").options(**options).load(path)


def tensors(spark: SparkSession, path: str, task_bytes: int = ranges.TASK) -> DataFrame:
    """(checkpoint, name, shape, kind, length, content) of every tensor at `path`."""
    return _load(spark, path, taskbytes=str(task_bytes))


def values(spark: SparkSession, path: str) -> DataFrame:
    """(checkpoint, name, value) of everything that is no tensor: counters, settings, flags."""
    return _load(spark, path, values="true")


def write(named: DataFrame, path: str, plain: dict | None = None) -> None:
    """(slot, shape, content) rows of f32 tensors as checkpoint files in the same format, one for each partition of
    `named`; every file holds `plain`. Files appear under their own names when they are whole."""
    ship(named.sparkSession)
    folder = path if "://" in path else f"file://{path}"

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        fs, base = ranges.opened(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}"
        part, rows = f"{base}/.{name}.{uuid.uuid4().hex}", []
        with fs.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for b in batches:
                for slot, shape, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    z.writestr(zipfile.ZipInfo(f"{name}/data/{len(rows)}"), content)
                    rows.append((slot, shape))
            z.writestr(zipfile.ZipInfo(f"{name}/data.pkl"), pickled(rows, plain or {}))
        if rows:
            fs.move(part, f"{base}/{name}.pt")
        else:
            fs.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    named.select("slot", "shape", "content").mapInArrow(turn, "n long").agg({"n": "sum"}).collect()  # one row


def pickled(rows: list[tuple[str, list[int]]], plain: dict) -> bytes:
    """The description of {'model': f32 tensors in dense order, **plain}, opcode by opcode."""

    def text(x: str) -> bytes:
        raw = x.encode()
        return b"X" + struct.pack("<I", len(raw)) + raw

    def number(x: int) -> bytes:
        return b"J" + struct.pack("<i", x) if -(2**31) <= x < 2**31 else b"\x8a\x08" + struct.pack("<q", x)

    def value(x: object) -> bytes:
        if isinstance(x, dict):
            return b"}(" + b"".join(text(k) + value(v) for k, v in x.items()) + b"u"
        if x is None or isinstance(x, bool):
            return {None: b"N", True: b"\x88", False: b"\x89"}[x]
        return text(x) if isinstance(x, str) else number(x) if isinstance(x, int) else b"G" + struct.pack(">d", x)

    def name(x: str) -> bytes:
        module, attribute = x.rsplit(".", 1)
        return f"c{module}\n{attribute}\n".encode()

    def tensor(key: int, shape: list[int]) -> bytes:
        stride = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
        storage = b"(" + text("storage") + name("torch.FloatStorage") + text(str(key)) + text("cpu") + number(math.prod(shape)) + b"tQ"
        sizes = b"".join(b"(" + b"".join(map(number, x)) + b"t" for x in (shape, stride))
        return name(TENSOR) + b"(" + storage + number(0) + sizes + b"\x89" + name(ORDERED) + b")R" + b"tR"

    model = b"}(" + b"".join(text(slot) + tensor(k, list(shape)) for k, (slot, shape) in enumerate(rows)) + b"u"
    return b"\x80\x02}(" + text("model") + model + b"".join(text(k) + value(v) for k, v in plain.items()) + b"u."
