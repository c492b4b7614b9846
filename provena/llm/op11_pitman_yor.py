"""Language-model scoring by a hierarchical Pitman-Yor process.

A token's restaurant is that of the whole word before it (of the end at a text's start). Its parent is named by
that word's last two bytes (in 32 groups each), the 32 endings that share a last byte share a parent, those share the
root, and the root's base is uniform over the training words and one unknown. Tokens are customers of the words'
restaurants, and each table of a restaurant is a customer of its parent. Seating is sampled by Gibbs: for each
restaurant and word in turn, the number of tables is drawn from its conditional given the tables of all others (who
sits where is summed out by generalised Stirling numbers: exact up to `EXACT` customers, by their scaling law beyond),
from the words' restaurants up to the root. The last samples are averaged: the tables of the words' restaurants, and
the probabilities of the endings'.

Words (by ranges of their hashes) lie in buckets of a block's size. The bucket of a word holds all its customers,
from every restaurant, so words are sampled independently given the restaurants' totals. Those of the endings up to
the root (1,024 + 32 + 1 numbers) are summed after each round and given to all. Those of the words' restaurants,
as many as there are words, are summed in the bucket of the word that names them: each round sends the tables of
pairs with two customers or more there, and brings the sums back (a pair of one customer has one table).
Counts, tables and answers travel as compressed arrays, one row for each bucket and block or bucket and bucket; the words
before are listed once in such a row. Texts are written once, in blocks, so that scoring brings the answers to the
texts and does not move the texts again; it takes the blocks in turns, so that the answers of one turn lie on disk at a
time. With many blocks, a bucket's rows are united in groups of blocks first (salts, each of one turn), then the groups'.

Words are told apart by 64 bits: 54 of their hash, and the ten that name their ending. Defined results: null and empty texts are one end token; rows without
an id are not learned from and count as not held out; repeated rows count each; without training texts
every token has probability 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import work
from .bytes_ import Words, buffers, release, slices

#: Rounds of sweeps between which totals are exchanged, sweeps of a round, and samples that are averaged.
ROUNDS, SWEEPS, KEPT = 3, 2, 3
DISCOUNT, STRENGTH, SEED = 0.8, 1.0, 17
#: Bytes of a block's texts, blocks that count a word together, turns of scoring, and customers with exact Stirling numbers.
BLOCK, TOGETHER, TURNS, EXACT = 16 << 20, 256, 4, 2048
GROUPS = 32
CONTEXTS = GROUPS * GROUPS
_END = CONTEXTS - 1  # of no letters
_ZSTD = pa.Codec("zstd", 1)


def _groups() -> np.ndarray:
    """Group of a byte: letters each their own, digits, two of other signs, two of bytes beyond ASCII."""
    g = np.array([27 + b % 2 if b < 128 else 29 + b % 2 for b in range(256)])
    g[97:123] = np.arange(26)
    g[65:91] = np.arange(26)
    g[48:58] = 26
    return g


_GROUP, _NONE = _groups(), 31
_MODEL = ["bucket", "word", "size", "prior", "before", "n"]
_FIELDS = "bucket long, word binary, size binary, prior binary, before binary, n binary"


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token (words, then the end): its text and its word, the ending in the word's last bits."""
    words = Words(buf, off)
    count = words.counts
    doc = np.repeat(np.arange(len(count)), count + 1)
    word = np.full(len(doc), _END, np.uint64)
    is_word = np.ones(len(doc), bool)
    is_word[np.cumsum(count + 1) - 1] = False  # places of the end tokens
    last = _GROUP[buf[words.ends - 1]]
    before = np.where(words.ends - words.starts > 1, _GROUP[buf[np.maximum(words.ends - 2, 0)]], _NONE)
    word[is_word] = words.hashes(fold=True) & ~np.uint64(CONTEXTS - 1) | (last * GROUPS + before).astype(np.uint64)
    return doc, word


def _ending(word: np.ndarray) -> np.ndarray:
    return (word & np.uint64(CONTEXTS - 1)).astype(np.int64)


def _block_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`tokens` of a block, a megabyte of texts at a time."""
    parts, lo = [], 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), "right")) - 1)
        doc, word = tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        parts.append((doc.astype(np.int32) + np.int32(lo), word))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _entries(word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct words, the first entry of each, of all entries (by word, then word before) the place of the word before
    among the words, and each token's entry."""
    names, number = np.unique(word, return_inverse=True)
    before = np.concatenate([np.searchsorted(names, np.array([_END], np.uint64)), number[:-1]])  # texts begin after an end
    pair, entry = np.unique(number * len(names) + before, return_inverse=True)
    return names, np.searchsorted(pair, np.arange(len(names) + 1) * len(names)), pair % len(names), entry.astype(np.int32)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block, used = TaskContext.get().partitionId() << 32, 0
    for batch, buf, _ in slices(batches):
        if used and used + len(buf) > BLOCK:
            block, used = block + 1, 0
        used += len(buf)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), *batch.columns], ["block", *batch.schema.names])


def _packed(values: np.ndarray) -> bytes:
    """How many values, then the first bytes of all, the second bytes of all and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(4, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True) if len(values) else b""


def _whole(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([_packed(values.astype(kind))], pa.binary())


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of `values` that begin at `first`, each packed."""
    return pa.array([_packed(values[a:b]) for a, b in itertools.pairwise(first.tolist())], pa.binary())


def _values(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed runs, and the first of each row."""
    raw, off = col.buffers()[2], np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].tolist()
    sizes = [int.from_bytes(raw[a : a + 4], "little") if b > a else 0 for a, b in itertools.pairwise(off)]
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.empty(first[-1], kind)
    rows = out.view(np.uint8).reshape(len(out), out.itemsize)
    for a, b, lo, n in zip(off, off[1:], first.tolist(), sizes, strict=False):
        if n:
            rows[lo : lo + n] = np.frombuffer(_ZSTD.decompress(raw.slice(a + 4, b - a - 4), n * out.itemsize), np.uint8).reshape(out.itemsize, n).T
    return out, first


def _all(rows: pa.Table, name: str, kind: str) -> np.ndarray:
    """The values of a column of packed runs, of all rows."""
    return _values(rows.column(name).combine_chunks(), kind)[0] if rows.num_rows else np.zeros(0, kind)


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _dealt(word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that hold some of the ascending words, and the first word of each (and the end)."""
    own = _bucket(word, buckets)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    return own[first], np.append(first, len(own))


def _steps(at: np.ndarray, first: np.ndarray, kind: str = "<u4") -> np.ndarray:
    """Ascending values of each row as steps from the one before; small numbers take little room."""
    out = np.diff(at, prepend=at.dtype.type(0))
    out[first[:-1][np.diff(first) > 0]] = at[first[:-1][np.diff(first) > 0]]
    return out.astype(kind)


def _places(rows: pa.Table, name: str, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The values that `_steps` were taken of, and the first of each row."""
    steps, first = _values(rows.column(name).combine_chunks(), kind)
    at = np.zeros(len(steps) + 1, np.uint64 if kind == "<u8" else np.int64)
    np.cumsum(steps, dtype=at.dtype, out=at[1:])  # of words modulo 2^64, as the difference below
    return at[1:] - np.repeat(at[first[:-1]], np.diff(first)), first


def _listed(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each run, the first of each, and of each value its place among those of its run."""
    runs = [np.unique(values[a:b], return_inverse=True) for a, b in itertools.pairwise(first.tolist())]
    return np.concatenate([x for x, _ in runs]), np.cumsum([0, *(len(x) for x, _ in runs)]), np.concatenate([at for _, at in runs])


def _counted(texts: pa.Table, buckets: int) -> pa.Table:
    """A row for each bucket: the block's words with their numbers of entries; the distinct words before; of each entry the
    place among these and the customers from training texts."""
    doc, word = _block_tokens(*buffers(texts.column("text")))
    learn = texts.column("learn").to_numpy()
    names, first, before, entry = _entries(word)
    n = np.bincount(entry[learn[doc]], minlength=len(before))
    del doc, word, entry
    own, cut = _dealt(names, buckets)
    at = first[cut]
    prior, prior_first, place = _listed(before, at)
    out = [pa.array(np.full(len(own), texts.column("block")[0].as_py())), pa.array(own), _binary(_steps(names, cut, "<u8"), cut), _binary(np.diff(first).astype("<u4"), cut), _binary(_steps(names[prior], prior_first, "<u8"), prior_first), _binary(place.astype("<u4"), at), _binary(n.astype("<u4"), at)]
    release()
    return pa.table(out, ["block", *_MODEL])


def _united(rows: pa.Table, by: str) -> pa.Table:
    """Rows of a bucket as one (`to` -1), and for each of them (`to`: its `by`) the places of its words and entries there."""
    words, row_words = _places(rows, "word", "<u8")
    names, number = np.unique(words, return_inverse=True)
    prior, row_prior = _places(rows, "prior", "<u8")
    prior, listed = np.unique(prior, return_inverse=True)
    before, row = _values(rows.column("before").combine_chunks(), "<u4")
    before = listed[before + np.repeat(row_prior[:-1], np.diff(row))]
    key = np.repeat(number, _all(rows, "size", "<u4")) * len(prior) + before
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(new)
    n = np.add.reduceat(_all(rows, "n", "<u4")[order].astype(np.int64), at)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    size = np.bincount(key[at] // len(prior), minlength=len(names))
    bucket = rows.column("bucket")[0].as_py()
    whole = lambda x: _whole(_steps(x, np.array([0, len(x)]), "<u8"), "<u8")
    one = [pa.array([-1]), pa.array([bucket]), whole(names), _whole(size, "<u4"), whole(prior), _whole(key[at] % len(prior), "<u4"), _whole(n, "<u4")]
    own = [rows.column(by).combine_chunks(), pa.array(np.full(rows.num_rows, bucket)), *(pa.nulls(rows.num_rows, pa.binary()) for _ in range(5))]
    none = pa.nulls(1, pa.binary())
    out = ["to", *_MODEL, "words_at", "entries_at"]
    return pa.concat_tables([pa.table([*one, none, none], out), pa.table([*own, _binary(_steps(number, row_words), row_words), _binary(_steps(place, row), row)], out)])


class Stirling:
    """Corrections delta(c, t) of generalised Stirling numbers of a discount d against their limit:
    S(c, t) = S(c, 1) exp(delta) / (t - 1)! / d^(t - 1), where delta goes to 0 as c grows. Exact for c up to
    EXACT; beyond, delta depends on t / c^d alone."""

    def __init__(self, d: float = DISCOUNT):
        self.d, self.rows = d, {}
        wanted = {*range(1, 65)} | {int(64 * 1.1**k) for k in range(100) if 64 * 1.1**k < EXACT} | {EXACT}
        t = np.arange(1, EXACT + 1)
        limit = np.cumsum(np.log(np.maximum(t - 1, 1))) + (t - 1) * np.log(d)
        s = np.full(EXACT, -np.inf)
        s[0] = 0.0
        for c in range(1, EXACT + 1):
            if c in wanted:
                self.rows[c] = (s - s[0] + limit)[:c].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                grown = s[: c + 1] + np.log(np.maximum(c - d * t[: c + 1], 1e-300))
                s[1 : c + 1] = np.logaddexp(grown[1:], s[: c]) if c < EXACT else s[1 : c + 1]
                s[0] = grown[0]
        self.at = np.array(sorted(self.rows))
        self.small = np.full((65, 64), -np.inf)
        for c in range(1, 65):
            self.small[c, :c] = self.rows[c]

    def delta(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For each c (rows, ascending) at each t (columns)."""
        own = self.at[np.searchsorted(self.at, c, "right") - 1]
        out = np.empty((len(c), len(t)))
        for k in np.unique(own).tolist():
            r = np.flatnonzero(own == k)
            x = (t[None, :] - 1) * (k / c[r][:, None]) ** self.d  # from 0
            low = np.minimum(x.astype(np.int64), k - 1)
            high, row = np.minimum(low + 1, k - 1), self.rows[k]
            out[r] = row[low] + (x - low) * (row[high] - row[low])
            out[r] = np.where((x > k - 1) | (t[None, :] > c[r][:, None]), -np.inf, out[r])
        return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def draw_tables(c: np.ndarray, h: np.ndarray, rest: np.ndarray, s: Stirling, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each (restaurant, word) from its conditional: c customers, h the parent's
    probability, rest the restaurant's tables of other words. One customer sits at one table."""
    out = np.minimum(c, 1).astype(np.int64)
    r, log_h = STRENGTH / s.d + np.maximum(rest, 0), np.log(h)
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]
    size = c[many]
    steps = [2, 4, 8, 16, 32, 64]
    cuts = [0, *np.searchsorted(size, steps, "right").tolist()]
    for top, lo, hi in zip(steps, cuts, cuts[1:], strict=False):
        for a in range(lo, hi, 1 << 15):
            own = many[a : min(hi, a + (1 << 15))]
            t = np.arange(1, top + 1)
            p = s.small[c[own], :top] + np.cumsum(np.log(r[own][:, None] + t) - np.log(np.maximum(t - 1, 1)) + log_h[own][:, None], 1)
            out[own] = t[(p + rng.gumbel(size=p.shape)).argmax(1)]
    for a in range(cuts[-1], len(many), 1 << 11):  # more customers: exact for few tables, then in steps of a twelfth
        own = many[a : a + (1 << 11)]
        top = int(c[own[-1]])
        edge = [*range(1, 34)]
        while edge[-1] <= top:
            edge.append(edge[-1] + max(1, edge[-1] // 12))
        low = np.array(edge[:-1])
        width = np.diff(edge)
        t = low + (width - 1) / 2
        p = s.delta(c[own], t) + _log_gamma(r[own][:, None] + t) - _log_gamma(t)[None, :] + t * log_h[own][:, None] + np.log(width)
        at = (p + rng.gumbel(size=p.shape)).argmax(1)
        out[own] = np.minimum(low[at] + (rng.random(len(own)) * width[at]).astype(np.int64), c[own])
    return out


class Totals:
    """Tables of every restaurant (contexts, parents, root) and customers of the contexts."""

    def __init__(self, context: np.ndarray, parent: np.ndarray, root: int, customers: np.ndarray, words: int):
        self.t2, self.t1, self.t0, self.c2, self.words = context, parent, root, customers, words
        self.c1, self.c0 = context.reshape(GROUPS, GROUPS).sum(1), int(parent.sum())


class Seating:
    """The tables of some words: entries (word, context), pairs (word, parent), and words."""

    def __init__(self, first: np.ndarray, own: np.ndarray):
        self.context, self.c2 = own & (CONTEXTS - 1), own >> 10
        self.word = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair, self.pair = np.unique(self.word * GROUPS + self.context // GROUPS, return_inverse=True)
        self.pair_word, self.parent = pair // GROUPS, pair % GROUPS
        self.n = len(first) - 1
        self.t2 = np.minimum(self.c2, 1)
        self._climb()
        self.t1 = np.minimum(self.c1, 1)
        self._climb()
        self.t0 = np.minimum(self.c0, 1)

    def _climb(self) -> None:
        total = lambda at, x, n: np.bincount(at, x, n).astype(np.int64)
        self.c1 = total(self.pair, self.t2, len(self.parent))
        if hasattr(self, "t1"):
            self.c0 = total(self.pair_word, self.t1, self.n)

    def root(self, g: Totals, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c - DISCOUNT * t + (STRENGTH + DISCOUNT * g.t0) / (g.words + 1)) / (STRENGTH + g.c0)

    def middle(self, g: Totals, at: np.ndarray, c: np.ndarray, t: np.ndarray, below: np.ndarray) -> np.ndarray:
        return (c - DISCOUNT * t + (STRENGTH + DISCOUNT * g.t1[at]) * below) / (STRENGTH + g.c1[at])

    def sweep(self, g: Totals, s: Stirling, rng: np.random.Generator) -> None:
        """Contexts, then parents, then the root; the parent's probability is that without a row's own tables."""
        p0 = self.root(g, self.c0, self.t0)
        c = self.c1[self.pair] - self.t2
        h = self.middle(g, self.parent[self.pair], c, np.minimum(self.t1[self.pair], c), p0[self.word])
        self.t2 = draw_tables(self.c2, h, g.t2[self.context] - self.t2, s, rng)
        self._climb()
        self.t1 = np.minimum(self.t1, self.c1)
        c = self.c0[self.pair_word] - self.t1
        h = self.root(g, np.maximum(c, 0), np.minimum(self.t0[self.pair_word], np.maximum(c, 0)))
        self.t1 = draw_tables(self.c1, h, g.t1[self.parent] - self.t1, s, rng)
        self._climb()
        self.t0 = draw_tables(self.c0, np.full(self.n, 1 / (g.words + 1)), g.t0 - np.minimum(self.t0, self.c0), s, rng)

    def predictive(self, g: Totals) -> np.ndarray:
        """The probability of each entry's word in its context."""
        p1 = self.middle(g, self.parent, self.c1, self.t1, self.root(g, self.c0, self.t0)[self.pair_word])
        at = self.context
        return (self.c2 - DISCOUNT * self.t2 + (STRENGTH + DISCOUNT * g.t2[at]) * p1[self.pair]) / (STRENGTH + g.c2[at])


class Pairs:
    """Customers and tables of a bucket's words in the words' restaurants, above them the seating of the endings."""

    def __init__(self, rows: pa.Table):
        self.words, size = _places(rows, "word", "<u8")[0], _all(rows, "size", "<u4")
        self.prior, self.before = _places(rows, "prior", "<u8")[0], _all(rows, "before", "<u4").astype(np.int64)
        self.c = _all(rows, "n", "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(self.words)), size)
        self.first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        key, self.above = np.unique(word * CONTEXTS + _ending(self.prior)[self.before], return_inverse=True)
        self.own, self.own_first = key % CONTEXTS, np.searchsorted(key, np.arange(len(self.words) + 1) * CONTEXTS)
        self.t, self.many = np.minimum(self.c, 1), np.flatnonzero(self.c > 1)
        self.rest = np.zeros(len(self.many), np.int64)

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of several customers by the word before, and that word's place of each."""
        order = np.argsort(self.before[self.many], kind="stable")
        return order, self.before[self.many][order]

    def take(self, back: pa.Table) -> None:
        """Tables of the last round, and of each pair's restaurant for other words."""
        if back.num_rows:
            back, (order, _) = back.sort_by("of"), self.sent()
            self.t[self.many[order]] = _all(back, "t", "<u4")
            self.rest[order] = _all(back, "rest", "<i8")

    def customers(self) -> np.ndarray:
        return np.bincount(self.above, self.t, len(self.own)).astype(np.int64)

    def seat(self) -> None:
        self.seats = Seating(self.own_first, self.own | self.customers() << 10)

    def sweep(self, g: Totals, s: Stirling, rng: np.random.Generator) -> None:
        """The words' restaurants, then those above; the ending's probability is that without a row's own tables."""
        x, at = self.seats, self.above[self.many]
        c, k = x.c2[at] - self.t[self.many], x.context[at]
        p1 = x.middle(g, x.parent, x.c1, x.t1, x.root(g, x.c0, x.t0)[x.pair_word])[x.pair[at]]
        h = (c - DISCOUNT * np.minimum(x.t2[at], c) + (STRENGTH + DISCOUNT * g.t2[k]) * p1) / (STRENGTH + g.c2[k])
        self.t[self.many] = draw_tables(self.c[self.many], h, self.rest, s, rng)
        x.c2 = self.customers()
        x.sweep(g, s, rng)


def _contexts(rows: pa.Table, buckets: int) -> pa.Table:
    """Of the words before, in their own buckets: customers, pairs of one customer and pairs of several."""
    c, at, before = _all(rows, "n", "<u4"), _all(rows, "before", "<u4"), _places(rows, "prior", "<u8")[0]
    some = np.bincount(at, c > 0, len(before)) > 0
    own, cut = _dealt(before[some], buckets)
    sums = [_binary(np.bincount(at, x, len(before))[some].astype("<i8"), cut) for x in (c == 1, c > 1)]
    return pa.table([pa.array(own), pa.array(np.full(len(own), rows.column("bucket")[0].as_py())), _binary(_steps(before[some], cut, "<u8"), cut), *sums], ["bucket", "home", "word", "single", "several"])


def _contexts_united(rows: pa.Table) -> pa.Table:
    """Pairs of one customer of the bucket's training words (`home` -1), and for each bucket with pairs of several the places
    of their words before, and how many there are of each."""
    given, row = _places(rows, "word", "<u8")
    word, at = np.unique(given, return_inverse=True)
    several = _all(rows, "several", "<i8")
    some = several > 0
    first = np.searchsorted(np.flatnonzero(some), row)
    full = np.diff(first) > 0
    first = np.append(first[:-1][full], first[-1])
    single = np.bincount(at, _all(rows, "single", "<i8"), len(word))
    bucket, none = rows.column("bucket")[0].as_py(), pa.nulls(1, pa.binary())
    names = ["bucket", "home", "single", "at", "several"]
    one = pa.table([pa.array([bucket]), pa.array([-1]), _whole(single, "<i8"), none, none], names)
    home = rows.column("home").to_numpy()[full]
    routes = pa.table([pa.array(np.full(len(home), bucket)), pa.array(home), pa.nulls(len(home), pa.binary()), _binary(_steps(at[some], first), first), _binary(several[some].astype("<u4"), first)], names)
    return pa.concat_tables([one, routes])


def _homes(contexts: pa.Table) -> tuple[np.ndarray, pa.Table]:
    home = contexts.column("home").to_numpy()
    return _all(contexts.filter(pa.array(home < 0)), "single", "<i8"), contexts.filter(pa.array(home >= 0)).sort_by("home")


def _round(rows: pa.Table, back: pa.Table | None, held, turn: int, sweeps: int, buckets: int) -> pa.Table:
    """Tables of pairs of several customers, sent to the buckets of the words before (`home` says where from); and one row of sums: tables by ending, by parent and of the root, customers by ending, words, tokens."""
    g, s = held.value
    bucket, x = rows.column("bucket")[0].as_py(), Pairs(rows)
    if back is not None:
        x.take(back)
    rng = np.random.default_rng([SEED, turn, bucket])
    x.seat()
    for _ in range(sweeps):
        x.sweep(g, s, rng)
    y = x.seats
    sums = np.concatenate([np.bincount(y.context, y.t2, CONTEXTS), np.bincount(y.parent, y.t1, GROUPS), [y.t0.sum()], np.bincount(y.context, y.c2, CONTEXTS), [(y.c0 > 0).sum(), x.c.sum()]]).astype(np.int64)
    order, before = x.sent()
    own, cut = _dealt(x.prior[before], buckets)
    sent = pa.table([pa.array(own), pa.array(np.full(len(own), bucket)), _binary(x.t[x.many[order]].astype("<u4"), cut), pa.nulls(len(own), pa.list_(pa.int64()))], ["bucket", "home", "t", "sums"])
    none = pa.nulls(1, pa.binary())
    release()
    return pa.concat_tables([sent, pa.table([pa.array([-1]), pa.array([bucket]), none, pa.array([sums.tolist()], pa.list_(pa.int64()))], sent.column_names)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's sums."""
    total = np.zeros(2 * CONTEXTS + GROUPS + 3, np.int64)
    for batch in batches:
        total += batch.column(0).flatten().to_numpy().reshape(-1, len(total)).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])


def _rested(contexts: pa.Table, sent: pa.Table) -> pa.Table:
    """The tables sent, and those of their restaurants for other words, back to where they came from."""
    if not sent.num_rows:
        return pa.table({"bucket": pa.array([], pa.int64()), "of": pa.array([], pa.int64()), "t": pa.array([], pa.binary()), "rest": pa.array([], pa.binary())})
    single, routes = _homes(contexts)
    sent = sent.sort_by("home")
    t, first = _values(sent.column("t").combine_chunks(), "<u4")
    at = np.repeat(_places(routes, "at")[0], _all(routes, "several", "<u4"))
    total = single + np.bincount(at, t, len(single)).astype(np.int64)
    return pa.table([sent.column("home"), sent.column("bucket"), sent.column("t"), _binary(total[at] - t, first)], ["bucket", "of", "t", "rest"])


_FINAL = "bucket long, home long, a binary, p binary, n binary"


def _predicted(rows: pa.Table, back: pa.Table, held, turn: int, buckets: int) -> pa.Table:
    """Means of the samples kept: of each pair its discounted customers and its probability by ending (`home` -1), and
    the tables of pairs of several customers, summed by the word before, for that word's bucket."""
    g, s = held.value
    bucket, x = rows.column("bucket")[0].as_py(), Pairs(rows)
    x.take(back)
    rng = np.random.default_rng([SEED, turn, bucket])
    x.seat()
    for _ in range(SWEEPS):
        x.sweep(g, s, rng)
    p, t = np.zeros(len(x.own)), np.zeros(len(x.c))
    for _ in range(KEPT):
        x.sweep(g, s, rng)
        p += x.seats.predictive(g)
        t += x.t
    p, t = p / KEPT, t / KEPT
    one = pa.table([pa.array([bucket]), pa.array([-1]), _whole(x.c - DISCOUNT * t, "<f4"), _whole(p[x.above], "<f4"), _whole(np.add.reduceat(x.c, x.first[:-1]), "<i8")], ["bucket", "home", "a", "p", "n"])
    order, before = x.sent()
    before, at = np.unique(before, return_inverse=True)
    own, cut = _dealt(x.prior[before], buckets)
    none = pa.nulls(len(own), pa.binary())
    sent = pa.table([pa.array(own), pa.array(np.full(len(own), bucket)), _binary(np.bincount(at, t[x.many[order]], len(before)), cut), none, none], one.column_names)
    release()
    return pa.concat_tables([one, sent])


def _informed(contexts: pa.Table, sent: pa.Table) -> pa.Table:
    """Tables of the training words' restaurants (`home` -2)."""
    single, routes = _homes(contexts)
    t = single.astype(float)
    if sent.num_rows:
        t += np.bincount(_places(routes, "at")[0], _all(sent.sort_by("home"), "a", "<f8"), len(t))
    none = pa.nulls(1, pa.binary())
    return pa.table([contexts.column("bucket")[:1].combine_chunks(), pa.array([-2]), _whole(t, "<f4"), none, none], ["bucket", "home", "a", "p", "n"])


def _known(rows: pa.Table) -> pa.Table:
    """A bucket's answers: of its words the training tokens (as many customers have their restaurants) and the tables of
    their restaurants; of its entries the discounted customers and the probability by ending."""
    home = rows.column("home").to_numpy()
    pairs = rows.filter(pa.array(home == -1))
    n = _all(pairs, "n", "<i8")
    t = np.zeros(len(n), "<f4")
    t[n > 0] = _all(rows.filter(pa.array(home == -2)), "a", "<f4")  # every training token comes before another one
    return pa.table([*(pairs.column(c) for c in ("bucket", "n")), _whole(t, "<f4"), *(pairs.column(c) for c in ("a", "p"))], ["bucket", "n", "t", "a", "p"])


def _answered(routes: pa.Table, known: pa.Table) -> pa.Table:
    """For each row that was united, in its order, what is known of its words and entries."""
    if not routes.num_rows:  # no block of this turn has words of the bucket
        return pa.table({"to": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in "ntap"}})
    word, first = _places(routes, "words_at")
    entry, row = _places(routes, "entries_at")
    cols = [_binary(_all(known, c, k)[at], f) for c, k, at, f in (("n", "<i8", word, first), ("t", "<f4", word, first), ("a", "<f4", entry, row), ("p", "<f4", entry, row))]
    release()
    return pa.table([routes.column("to"), routes.column("bucket"), *cols], ["to", "bucket", "n", "t", "a", "p"])


def _scored(texts: pa.Table, answers: pa.Table, train: int, words: int) -> pa.Table:
    """The rows of one block with their scores."""
    answers = answers.sort_by("bucket")  # as the block's own entries lie
    n, t = _all(answers, "n", "<i8"), _all(answers, "t", "<f4")
    doc, token = _block_tokens(*buffers(texts.column("text")))
    _, own_first, before, entry = _entries(token)
    size = texts.num_rows
    del token
    logs = np.log10((_all(answers, "a", "<f4") + (STRENGTH + DISCOUNT * t[before].astype(float)) * _all(answers, "p", "<f4")) / (STRENGTH + n[before]))
    at = np.searchsorted(own_first, entry, "right") - 1  # the token's word
    total = lambda x: np.bincount(doc, x, size)
    base = np.log10((n + 0.1) / (train + 0.1 * (words + 1))) if words else np.zeros(len(n))
    whole = lambda x: pa.array(x.astype(np.int64))
    out = pa.table([texts.column("doc_id"), texts.column("held_out"), whole(np.bincount(doc, minlength=size)), whole(total(n[at] > 0)), pa.array(np.full(size, train)), pa.array(total(base[at])), pa.array(total(logs[entry]))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    del doc, entry, at, n, t, logs, before
    release()
    return out


def score(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 10 = 0") -> DataFrame:
    """Every row of `docs` with its token counts, base score and score, learned from rows not held out."""
    conf, name = docs.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = conf.get(name, "false")
    conf.set(name, "true")  # no shuffle here is read by a second action
    try:
        return _score(docs, held_out)
    finally:
        conf.set(name, given)


def _score(docs: DataFrame, held_out: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = []

    turn_of = lambda block: f"cast(pmod({block} + shiftright({block}, 32), {TURNS}) as int)"

    def placed(df: DataFrame | list[DataFrame], name: str, *by: str, turns: str = "") -> DataFrame:
        """Written once (of several, one after the other), in Spark's buckets, so that grouping by `by` does not move it
        again; with the blocks named by `turns` in a folder for each turn (rows of none in -1)."""
        made.append((f"provena_{name}_{uuid.uuid4().hex}", f"{work.folder(spark)}/provena/{name}-{uuid.uuid4().hex}"))
        for x in df if isinstance(df, list) else [df]:
            if turns:
                x = x.withColumn("turn", F.expr(f"if({turns} < 0, -1, {turn_of(turns)})"))
            out = x.write.mode("append").option("path", made[-1][1]).option("compression", "zstd").bucketBy(parts, *by)
            (out.partitionBy("turn") if turns else out).saveAsTable(made[-1][0])
        return spark.table(made[-1][0])

    rows = docs.selectExpr("doc_id", f"coalesce({held_out}, false) as held_out", f"coalesce(not ({held_out}), false) as learn", "coalesce(text, '') as text")
    blocks = placed(rows.mapInArrow(_blocked, f"block long, doc_id {kind}, held_out boolean, learn boolean, text string"), "blocks", "block", turns="block")
    count = blocks.select("block").distinct().count()
    salted, buckets = count >= TOGETHER, max(parts, count)
    salt = f"{turn_of('block')} + {TURNS} * pmod(xxhash64(block), {1 + count // (TOGETHER * TURNS)})" if salted else "0L"
    fields = f"to long, {_FIELDS}, words_at binary, entries_at binary"

    def unite(blocks: DataFrame) -> DataFrame:
        counted = blocks.select("block", "learn", "text").groupBy("block").applyInArrow(lambda t: _counted(t, buckets), f"block long, {_FIELDS}")
        of_bucket = lambda key, t: _united(t, "block").append_column("salt", pa.array(np.full(t.num_rows + 1, key[1].as_py())))
        return counted.withColumn("salt", F.expr(salt)).groupBy("bucket", "salt").applyInArrow(of_bucket, f"{fields}, salt long")

    united = placed([unite(blocks.filter(F.col("turn") == turn)) for turn in range(TURNS)] if salted else unite(blocks), "blocks_united", "bucket", turns="to")
    model = united.filter("turn < 0").select("salt", *_MODEL)
    if salted:
        path = made[-1][1]
        again = placed(model.groupBy("bucket").applyInArrow(lambda t: _united(t, "salt"), fields), "salts_united", "bucket")
        work.remove(spark, f"{path}/turn=-1")  # no later plan reads it
        model = again.filter("to < 0")
    model = model.select(*_MODEL)
    fields = "bucket long, home long, word binary, single binary, several binary"
    contexts = model.groupBy("bucket").applyInArrow(lambda t: _contexts(t, buckets), fields).groupBy("bucket").applyInArrow(_contexts_united, "bucket long, home long, single binary, at binary, several binary")
    contexts = placed(contexts, "contexts", "bucket")
    g, s = Totals(np.zeros(CONTEXTS, np.int64), np.zeros(GROUPS, np.int64), 0, np.zeros(CONTEXTS, np.int64), 0), Stirling()
    train, back, sent = 0, None, None
    first_round = lambda held: lambda rows: _round(rows, None, held, 0, 0, buckets)
    later_round = lambda held, turn: lambda rows, back: _round(rows, back, held, turn, SWEEPS, buckets)
    for turn in range(ROUNDS + 1):  # the first counts one table for each entry
        held = spark.sparkContext.broadcast((g, s))
        fields = "bucket long, home long, t binary, sums array<long>"
        if back is None:
            seated = model.groupBy("bucket").applyInArrow(first_round(held), fields)
        else:
            seated = model.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(later_round(held, turn), fields)
        last, sent = sent, work.save(seated, "tables")
        if last is not None:
            work.drop(last)
        sums = sent.filter("bucket < 0").select("sums").mapInArrow(_added, "sums array<long>").collect()  # one row for each task
        x = np.sum([r.sums for r in sums] or [np.zeros(2 * CONTEXTS + GROUPS + 3)], axis=0).astype(np.int64)
        a, b = CONTEXTS, CONTEXTS + GROUPS
        g, train = Totals(x[:a], x[a:b], int(x[b]), x[b + 1 : -2], int(x[-2])), int(x[-1])
        back = contexts.groupBy("bucket").cogroup(sent.filter("bucket >= 0").groupBy("bucket")).applyInArrow(_rested, "bucket long, of long, t binary, rest binary")
    held = spark.sparkContext.broadcast((g, s))
    final = work.save(model.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(lambda t, b: _predicted(t, b, held, ROUNDS + 1, buckets), _FINAL), "predicted")
    work.drop(sent)
    info = contexts.groupBy("bucket").cogroup(final.filter("home >= 0").groupBy("bucket")).applyInArrow(_informed, _FINAL)
    fields = "n binary, t binary, a binary, p binary"
    known = final.filter("home < 0").unionByName(info).groupBy("bucket").applyInArrow(_known, f"bucket long, {fields}")
    fields = f"to long, bucket long, {fields}"
    known = placed(known, "known", "bucket")
    work.drop(final)
    by = ["bucket", "salt"] if salted else ["bucket"]
    words, scored = g.words, []
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    for turn in range(TURNS):
        routes = united.filter(F.col("turn") == turn).select("to", "bucket", "salt", "words_at", "entries_at")
        mine = known
        if salted:
            of_turn = again.filter(f"to >= 0 and pmod(to, {TURNS}) = {turn}").select("to", "bucket", "words_at", "entries_at")
            mine = of_turn.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answered, fields).withColumnRenamed("to", "salt")
        answers = routes.groupBy(*by).cogroup(mine.groupBy(*by)).applyInArrow(_answered, fields).withColumnRenamed("to", "block")
        texts = blocks.filter(F.col("turn") == turn).select("block", "doc_id", "held_out", "learn", "text")
        scored.append(work.save(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: _scored(left, right, train, words), out), "scores"))
    result = functools.reduce(DataFrame.union, scored)
    for name, path in made:
        spark.sql(f"drop table {name}")
        work.remove(spark, path)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of `documents`, learned from the nine tenths whose id's CRC-32 allows it."""
    return score(table(spark, sf_dir, "documents"))
