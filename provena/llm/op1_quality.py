"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts makes the statistics (a narrow work table). Trees are grown on the driver from a
bounded sample of labelled rows (`SAMPLE`, by a hash of the id): features are binned once, each level's
gradients are summed by (node, bin) with one bincount a feature, and splits follow the second-order gain.
Trees are perfect and flattened into arrays, so scoring a batch is `depth` numpy gathers a tree.

Defined results: null and empty texts have zero statistics and are scored like any text; null labels are
not learned from; an id labelled twice has its higher label, an id of several texts stands for its least
statistics; without both labels the score is their
share (0.5 without any); texts of any length are read whole; repeated rows score alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import work
from .bytes_ import Words, byte_set, column, list_array, slices, totals
from .docstats import SYMBOLS, Lines, code_points, distinct, repeated

#: Most labelled rows to learn from.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 60, 4, 0.15, 1.0, 4.0
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "bars", "distinct", "top_word", "runs", "dup_lines", "repeat8", "repeat3", "line_words", "short_words", "long_words", "shouting", "commas")
_UPPER, _DIGIT, _MARK, _BAR, _STOP = byte_set(bytes(range(65, 91))), byte_set(b"0123456789"), byte_set(b"!?"), byte_set(b"|"), byte_set(b".,;:")


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(off) - 1
    words = Words(buf, off)
    h, doc, count = words.hashes(), words.docs(), words.counts
    size = words.ends - words.starts
    chars = totals(words.solid & code_points(buf), off)
    lines = Lines(buf, off, words, h)
    n_lines = np.bincount(lines.doc, minlength=n)
    kinds, most = distinct(h, doc, n)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=upper[1:])
    loud = 2 * (upper[words.ends] - upper[words.starts]) > size
    per_word = lambda x: x / np.maximum(count, 1)
    per_char = lambda x: x / np.maximum(chars, 1)
    by = lambda mask: np.bincount(doc, mask, minlength=n)
    return np.column_stack([
        np.log1p(count), per_word(chars), per_char(totals(SYMBOLS[buf], off)), per_char(totals(_UPPER[buf], off)), per_char(totals(_DIGIT[buf], off)), per_char(totals(_MARK[buf], off)),
        per_word(totals(_BAR[buf], off)), per_word(kinds), per_word(most), per_word(by(same)), (n_lines - distinct(lines.raw, lines.doc, n)[0]) / np.maximum(n_lines, 1),
        per_word(repeated(h, words.first, 8, n)), per_word(repeated(h, words.first, 3, n)), count / np.maximum(n_lines, 1), per_word(by(size <= 2)), per_word(by(size >= 12)), per_word(by(loud & (size > 1))), per_word(totals(_STOP[buf], off)),
    ])


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(f) + 1))):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost on logistic loss."""
    share = float(y.mean()) if len(y) else 0.5
    none = Forest(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0)
    if not len(y) or share in (0.0, 1.0):
        none.bias = 0.0 if not len(y) else float(np.sign(share - 0.5) * 5)
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)])
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, w = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for j, q in enumerate(cuts):
                if not len(q):
                    continue
                cell = (at - base) * BINS + binned[:, j]
                gs = np.bincount(cell, g, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                ws = np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                ga, wa, gl, wl = gs[:, -1:], ws[:, -1:], gs[:, : len(q)], ws[:, : len(q)]
                gain = gl**2 / (wl + RIDGE) + (ga - gl) ** 2 / (wa - wl + RIDGE) - ga**2 / (wa + RIDGE)
                gain[(wl < LEAST / 4) | (wa - wl < LEAST / 4)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                won = top > best
                best[won] = top[won]
                feature[t, base : base + nodes][won] = j
                cut[t, base : base + nodes][won] = q[k[won]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        at -= inner
        value = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, w, leaves) + RIDGE)
        leaf[t] = value
        margin += value[at]
    return Forest(feature, cut, leaf, bias)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        x = statistics(buf, off)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), list_array(x.ravel(), np.arange(len(off)) * len(FEATURES), pa.float64())], ["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_described, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def learn(described: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on labelled documents whose crc32(doc_id) mod 3 is not 1."""
    own = labels.filter("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows from here on
    rows = described.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).orderBy("doc_id").select("x", "label").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    return grow(x, y)


def _scored(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = column(batch, "x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(forest.probability(x))], ["doc_id", "score"])


def score(described: DataFrame, forest: Forest) -> DataFrame:
    return described.mapInArrow(lambda it: _scored(it, forest), f"doc_id {described.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of `documents`, learned from `labels`."""
    described = work.save(describe(table(spark, sf_dir, "documents")), "statistics")
    forest = learn(described, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return score(described, forest).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
