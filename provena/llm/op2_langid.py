"""Language ID: multilingual mixture inference.

Each language has a table of log-likelihoods of hashed byte 4-grams of case-folded words (edges marked),
so a word has one likelihood for each language. A document is a mixture: expectation-maximisation over
its words estimates the languages' proportions. The set of languages is chosen by penalised likelihood
(BIC): the most probable language alone is kept unless a larger set gains more than its penalty; as no
set can beat all languages together, most documents are settled by one comparison.

Learned from a bounded sample for each language (`SAMPLE` documents on average, by a hash of the id),
from text and language of documents whose crc32(doc_id) mod 5 is not 0. Defined results: null text and
text without letters are `und` with score 0; without any training language all texts are `und`; null
languages are not learned from; texts of any length are read whole; repeated rows are predicted alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .bytes_ import Words, column, list_array, slices

#: Documents for each language to learn from, on average.
SAMPLE = 1500
BITS = 16
ROUNDS = 12
#: Weight of the common distribution of grams in each language's table.
SMOOTH = 0.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_LETTER[0x80:0xC0] = True  # continuation bytes of other letters


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Gram bucket of each letter byte with the three bytes before it in its run of letters, the run
    of each such byte, and the runs of letters as words."""
    letters = np.where(_LETTER[buf], _FOLD[buf], np.uint8(32))
    two = np.flatnonzero((letters[1:] >= 0x80) & (letters[1:] < 0x9F) & (letters[:-1] == 0xC3)) + 1
    letters[two] += 32  # capital Latin-1 letters
    words = Words(letters, off)
    size = words.ends - words.starts
    total = int(size.sum())
    run = np.repeat(np.arange(len(size)), size)
    data = letters[words.solid].astype(np.uint32)
    at = np.zeros(len(size), np.int64)
    at[1:] = np.cumsum(size)[:-1]
    pos = np.arange(total) - at[run] if total else np.zeros(0, np.int64)
    code = data.copy()
    for k in range(1, 4):
        back = np.zeros(total, np.uint32)
        back[k:] = data[:-k] if total > k else 0
        back[pos < k] = 32 if k == 1 else 0  # the edge, then nothing
        code = code * np.uint32(0x01000193) ^ back * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - BITS)).astype(np.int64), run, words


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # 2**BITS x languages


def _counts(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, count) of a partition: bounded by languages and buckets."""
    total = np.zeros((len(langs), 1 << BITS), np.int64)
    index = {k: i for i, k in enumerate(langs)}
    for batch, buf, off in slices(batches):
        code, run, words = grams(buf, off)
        lang = np.array([index[x] for x in column(batch, "lang").to_pylist()], np.int64)
        cell = lang[words.docs()[run]] * (1 << BITS) + code
        total += np.bincount(cell, minlength=total.size).reshape(total.shape)
    k, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], ["k", "bucket", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    known = docs.filter("doc_id is not null and lang is not null and text is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)))
    rate = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, sample / size[k]))))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    rows = drawn.select("lang", "text").mapInArrow(lambda it: _counts(it, langs), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    count = np.full((len(langs), 1 << BITS), 0.0)
    count[rows.column("k").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    count += SMOOTH * (count.sum(0) + 1) / (count.sum() + 1) * 100 + 1e-3  # towards the common distribution
    return Model(langs, np.log(count / count.sum(1, keepdims=True)).T.astype(np.float32))


def _em(like: np.ndarray, first: np.ndarray, pi: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents (at least one word each) from the words' likelihoods."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        r = like * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first[:-1]) / n[:, None]
    return pi, np.add.reduceat(np.log((like * pi[doc]).sum(1)), first[:-1])


def infer(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the chosen language set of each document; zero outside the set."""
    n, k = np.diff(first), like.shape[1]
    full, best = _em(like, first, np.full((len(n), k), 1 / k))
    order = np.argsort(-full, axis=1, kind="stable")
    top = order[:, 0]
    doc = np.repeat(np.arange(len(n)), n)
    alone = np.add.reduceat(np.log(like[np.arange(len(doc)), top[doc]]), first[:-1])
    cost = 0.5 * np.log(n + 1.0)
    out = np.zeros_like(full)
    out[np.arange(len(n)), top] = 1
    chosen = alone
    open_ = np.flatnonzero(best - cost > alone)  # one more language costs at least this
    for size in range(2, k + 1):
        if not len(open_):
            break
        words = np.flatnonzero(np.isin(doc, open_))
        at = np.concatenate([[0], np.cumsum(n[open_])])
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :size], 1 / size, 1)
        pi, got = _em(like[words], at, allowed)
        got -= cost[open_] * (size - 1)
        won = got > chosen[open_]
        out[open_[won]] = pi[won]
        chosen[open_[won]] = got[won]
    return out


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        n, k = batch.num_rows, len(model.langs)
        pi = np.zeros((n, k))
        letters = np.zeros(n, bool)
        if k:
            code, run, words = grams(buf, off)
            some = np.flatnonzero(words.counts)
            letters[some] = True
            if len(some):
                start = np.flatnonzero(np.diff(run, prepend=-1))
                like = np.add.reduceat(model.logp[code], start, axis=0)
                like = np.exp(np.maximum(like - like.max(1, keepdims=True), -25)).astype(np.float64)
                pi[some] = infer(like, np.append(words.first[some], words.first[-1]))
            for i in _doubtful(buf, off, some):
                letters[i] = any(c.isalpha() for c in column(batch, "text")[int(i)].as_py())
        best = pi.argmax(1) if k else np.zeros(n, int)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string()), pa.array(np.where(letters, pi.max(1) if k else 0.0, 0.0)), list_array((pi * letters[:, None]).ravel(), np.arange(n + 1) * k, pa.float64())],
            ["doc_id", "lang_pred", "score", "proportions"],
        )


def _doubtful(buf: np.ndarray, off: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Texts whose only candidates for letters are bytes beyond ASCII."""
    plain = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf] & (buf < 0x80), out=plain[1:])
    return some[plain[off[some + 1]] == plain[off[some]]]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (proportion of that language) and the proportions in the model's order."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of a float for each language
    return docs.select("doc_id", "text").mapInArrow(lambda it: _predicted(it, held.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, proportions array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return predict(docs, learn(docs)).select("doc_id", held, "lang_pred", "score")
