"""Counts over whole texts that quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np

from .bytes_ import Words, byte_set, mix, segment_hashes, totals, windows

SYMBOLS = byte_set(b"#*$%&|<>")


class Lines:
    """`\\n`-split lines that hold a word: `doc`, `raw` (hash of the exact line), `norm` (hash of its
    case-folded words, so white space does not count), `words`, and `starts`, their first bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, words: Words, folded: np.ndarray):
        solid = buf != 10
        before = np.ones(len(buf) + 1, bool)
        before[1:] = ~solid
        before[off] = True
        starts = np.flatnonzero(solid & before[:-1])
        after = np.ones(len(buf) + 1, bool)
        after[:-1] = ~solid
        after[off] = True
        ends = np.flatnonzero(solid & after[1:]) + 1
        raw = segment_hashes(buf[solid], ends - starts)
        line = np.searchsorted(starts, words.starts, "right") - 1
        own, first, count = np.unique(line, return_index=True, return_counts=True)
        self.doc = np.searchsorted(off, starts[own], "right") - 1
        self.raw, self.words, self.starts = raw[own], count, starts[own]
        place = np.arange(len(line)) - np.repeat(first, count)
        value = mix(folded + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.norm = mix(np.add.reduceat(value, first) + count.astype(np.uint64)) if len(own) else np.zeros(0, np.uint64)


def distinct(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its most frequent one."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n), most


def repeated(h: np.ndarray, first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words of each text that lie in a window of `size` words found twice or more in it."""
    value, at = windows(h, first, size)
    if not len(at):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return totals(np.cumsum(edge[:-1]) > 0, first)


def code_points(buf: np.ndarray) -> np.ndarray:
    """Marks the bytes that begin a code point."""
    return (buf & 0xC0) != 0x80
