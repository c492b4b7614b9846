"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One automaton over all keywords runs once through each slice of texts (joined, ASCII case folded);
a regular expression is tried only at a keyword's own position, so texts without keywords cost one
pass. Bare hex runs have no keyword and come from a byte-class scan. Beside the base spans (assign,
access, hex) the method adds kinds that carry their own proof: `github` and `npm` tokens end in a
base-62 CRC-32 of their body, a `jwt` has a decodable JSON header with an `alg`, a `pem` private key
has a base-64 body whose DER length is the decoded length. Candidates that fail the proof are dropped.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; a span
never crosses into another text; spans of different kinds may overlap and all are reported; repeated
rows and null ids are scanned like others; an empty table gives no rows; extra columns are ignored by
`find` and kept by `redact`. Every byte is read a bounded number of times, so a text's time grows with its
length alone.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .bytes_ import column, slices

#: Kinds in the order of the contract, then the method's own.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_MASK = "[SECRET]"

# Fixed formats of public token kinds and of the contract.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]*+")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_WORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin",),
}
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(x: int) -> str:
    out = ""
    while x:
        x, r = divmod(x, 62)
        out = _DIGITS[r] + out
    return out.rjust(6, "0")


def _crc(m: re.Match) -> bool:
    return _base62(zlib.crc32(m[1])) == m[2].decode()


def _json_header(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError):
        return False


def _der(m: re.Match) -> bool:
    try:
        raw = base64.b64decode(b"".join(m[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    wide = raw[1] & 0x7F if raw[1] & 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1]
    return size + 2 + wide == len(raw)


_CHECKS = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "github": (_GITHUB, _crc),
    "npm": (_NPM, _crc),
    "jwt": (_JWT, _json_header),
    "pem": (_PEM, _der),
}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in _WORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _hex_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(buf) + 1, np.int8)
    mask = _HEX[buf]
    inner = np.diff(mask.view(np.int8), prepend=0, append=0)
    edge += inner
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(buf))])
    cut = cut[mask[cut - 1] & mask[cut]] if len(cut) else cut  # runs that would cross into the next text
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    keep = ends - starts >= 16
    return starts[keep], ends[keep]


def spans(buf: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, index of the kind, end) in code points of that text, sorted."""
    raw = buf.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    last: dict[tuple[int, str], int] = {}
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(raw.lower().decode("latin-1")))
    docs = np.searchsorted(off, np.array([h[0] for h in hits], np.int64), "right") - 1
    for (at, kind), d in zip(hits, docs.tolist(), strict=True):
        if at < last.get((d, kind), 0):
            continue
        pattern, valid = _CHECKS[kind]
        if m := pattern.match(raw, at, int(off[d + 1])):
            last[d, kind] = m.end()
            if valid(m):
                found.setdefault(d, []).append((at, KINDS.index(kind), m.end()))
        elif kind == "jwt" and raw.startswith(b"eyJ", at):  # later starts in the run that failed would fail at the same place
            last[d, kind] = _JWT_RUN.match(raw, at, int(off[d + 1])).end()
    starts, ends = _hex_runs(buf, off)
    for d, s, e in zip((np.searchsorted(off, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        found.setdefault(d, []).append((s, KINDS.index("hex"), e))
    for d, list_ in found.items():
        marks = sorted({x for s, _, e in list_ for x in (s, e)})
        lead, at, where = 0, int(off[d]), {}
        for x in marks:  # bytes to code points: continuation bytes do not count
            part = buf[at:x]
            lead += int(((part & 0xC0) != 0x80).sum())
            at, where[x] = x, lead
        found[d] = sorted((where[s], k, where[e]) for s, k, e in list_)
    return found


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch, buf, off in slices(batches):
        found = spans(buf, off)
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found.get(i, ())] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of each row, by start, then kind."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        found = spans(buf, off)
        if found:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for d, list_ in found.items():
                out, here = [], 0
                for s, _, e in list_:
                    if e > here:
                        if s >= here:
                            out += [texts[d][here:s], _MASK]
                        here = e
                texts[d] = "".join(out) + texts[d][here:]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        yield batch


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span of `text` replaced by one mark; overlapping spans
    become one."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_redacted, docs.schema)


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`."""
    found = find(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in BASE]
    own = _joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *count, F.sha2(own, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
