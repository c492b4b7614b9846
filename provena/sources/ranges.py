"""Byte ranges of files in any store that pyarrow opens, for sources that read parts of large files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs

#: Bytes of one row's content at most where entries come in chunks, and of compressed bytes a task is given.
CHUNK, TASK = 4 << 20, 64 << 20


def opened(uri: str):
    """(file system, path) of a URI or of a local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def listed(uri: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or the files below a folder with one of the suffixes, as URIs, by name."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.is_file:
        return [uri if "://" in uri else f"file://{uri}"]
    head = (uri if "://" in uri else f"file://{uri}").removesuffix("/").removesuffix(path.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(f"{head}{f.path}" for f in found if f.is_file and f.path.endswith(suffixes) and not f.base_name.startswith((".", "_")))


def read(stream, start: int, size: int) -> Iterator[bytes]:
    """`size` bytes from `start`, a chunk at a time; a shorter file fails."""
    stream.seek(start)
    while size:
        part = stream.read(min(CHUNK, size))
        if not part:
            raise EOFError("the file ends inside an entry")
        size -= len(part)
        yield part


def inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Raw deflate data, decompressed a chunk at a time."""
    z = zlib.decompressobj(-15)
    for part in parts:
        while part:
            if out := z.decompress(part, CHUNK):
                yield out
            part = z.unconsumed_tail
    while out := z.decompress(z.unconsumed_tail, CHUNK):
        yield out
    if out := z.flush():
        yield out


def regrouped(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in pieces of `size`; the last may be shorter."""
    held = bytearray()
    for part in parts:
        held += part
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)
