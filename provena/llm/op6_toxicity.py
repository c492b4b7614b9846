"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned: terms whose share of toxic training documents is significantly high, on their
own or together with the other terms of their stem (`STEMS` letters), and that stand in several
different contexts. Copies of a text count once, and a toxic text counts for a term only if it adds a context
(the words beside the term) that no other text counts for; what is new in near copies counts as one more text.
All terms form a trie; the automaton that accepts every string within a term's edit limit is the
trie's states paired with edits spent, made deterministic lazily and kept for reuse, so a distinct word
costs one step for each character until it dies, whatever the number of terms. Each hit is scored in
a window of words: quotation marks and quoting verbs weigh it down, other hits, shouting and direct
address weigh it up. A logistic regression over a document's exact, one-edit and two-edit weights gives
the probability.

Learned from a bounded sample of labelled documents (`SAMPLE`, by a hash of the id); everything else
covers every whole text. Defined results: null and empty texts score as texts without hits; null labels
are not learned from; an id or a text labelled twice counts as toxic if any label is, and an id of several
texts stands for the least of them; texts of any length are read whole, one at a time; repeated rows are scored alike; an empty table gives no rows; extra columns are ignored by `score` and kept by `screen`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import work
from .bytes_ import column, slices

#: Most labelled documents to learn from; their terms bound the lexicon.
SAMPLE = 8000
#: A term is at least so many times likelier in toxic documents than in clean ones.
RATIO = 20.0
#: Letters of the stems that a term shares with its inflected forms.
STEMS = (4, 5)
#: A term stands between so many different pairs of words; a text with a smaller share of new ones is a near copy.
CONTEXTS, FRESH = 3, 0.5
#: Words on either side of a hit.
WINDOW = 10
_WORD = re.compile(r"[^\W_]+")
_FINE = re.compile(r"[^\W_]+|[\"“”«»„\n]|!!")
#: Fixed list: words that introduce a quotation or a mention, and direct address.
_QUOTING = frozenset("said says wrote called quote quoted term word slur phrase".split())
_ADDRESS = frozenset("you your you're du dein tu ton vous tú usted".split())
#: Words, and states of the automaton, that a worker remembers.
_KEPT = 100_000


def limit(term: str) -> int:
    """Edits that a term allows."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """Accepts words within `limit(term)` edits of a term; `distance(word)` is 0, 1, 2 or 9 (none)."""

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.most, ends = [0], {}
        for t in terms:
            at, own = 0, limit(t)
            self.most[0] = max(self.most[0], own)
            for c in t:
                at = self.child[at].setdefault(c, len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.most.append(0)
                self.most[at] = max(self.most[at], own)
            ends[at] = own
        self.ends = ends
        self.letters = {c for d in self.child for c in d}
        self.known: dict[str, int] = {}
        self._begin()

    def _begin(self) -> None:
        """No states yet but the first; they are a cache and come back when they are needed."""
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.accept: list[int] = []
        self.step: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, low: dict[int, int]) -> int:
        """Number of the state with these trie nodes at their fewest edits; -1 if it is empty."""
        todo = list(low)
        while todo:  # a skipped letter of the term costs an edit
            node = todo.pop()
            e = low[node] + 1
            for nxt in self.child[node].values():
                if e <= self.most[nxt] and e < low.get(nxt, 9):
                    low[nxt] = e
                    todo.append(nxt)
        if not low:
            return -1
        key = frozenset(low.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.accept.append(min((e for node, e in low.items() if e <= self.ends.get(node, -1)), default=9))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        low: dict[int, int] = {}
        for node, e in self.states[state]:
            for letter, nxt in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[nxt] and cost < low.get(nxt, 9):
                    low[nxt] = cost
            if e + 1 <= self.most[node] and e + 1 < low.get(node, 9):  # an added letter
                low[node] = e + 1
        out = self.step[state][c] = self._state(low)
        return out

    def distance(self, word: str) -> int:
        if (got := self.known.get(word)) is not None:
            return got
        if len(self.states) > _KEPT:
            self._begin()
        at = self.start
        for c in word:
            if c not in self.letters:
                c = ""
            nxt = self.step[at].get(c)
            if nxt is None:
                nxt = self._move(at, c)
            at = nxt
            if at < 0:
                break
        got = self.accept[at] if at >= 0 else 9
        if len(self.known) >= _KEPT:
            self.known.clear()
        self.known[word] = got
        return got


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * 7)
    bias: float = -5.0


_automata: dict[tuple, Automaton] = {}


def _automaton(terms: list[str]) -> Automaton:
    key = tuple(terms)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(terms)
    return _automata[key]


def features(text: str | None, auto: Automaton) -> list[float] | None:
    """Summed weights of exact, one-edit and two-edit hits and their context; None without hits."""
    low = (text or "").lower()
    distance = auto.distance
    if min(map(distance, set(_WORD.findall(low))), default=9) > 2:
        return None
    words, quoted, loud, hits = [], [], [], []
    open_ = False
    for t in _FINE.findall(low):
        if t == "\n":
            open_ = False
        elif t == "!!":
            if loud:
                loud[-1] = True
        elif not t[0].isalnum():
            open_ = not open_ if t == '"' else t in "“«„"
        else:
            d = distance(t)
            if d <= 2:
                hits.append((len(words), d))
            words.append(t)
            quoted.append(open_)
            loud.append(False)
    at = np.array([h[0] for h in hits])
    total, best, inside = [0.0, 0.0, 0.0], 0.0, 0
    for i, d in hits:
        lo, hi = max(0, i - WINDOW), i + WINDOW + 1
        near = int(np.searchsorted(at, hi) - np.searchsorted(at, lo)) - 1
        mention = quoted[i] or not _QUOTING.isdisjoint(words[max(0, i - 3) : i])
        w = (0.25 if mention else 1.0) * (1 + 0.25 * min(near, 4)) * (1.2 if any(loud[lo:hi]) or not _ADDRESS.isdisjoint(words[lo:hi]) else 1.0)
        total[d] += w
        inside += mention
        if d == 0:
            best = max(best, w)
    return [float(total[0] > 0.5), np.log1p(total[0]), np.log1p(total[1]), np.log1p(total[2]), best, inside / len(hits), np.log1p(len(hits)) / np.log1p(len(words) + 1)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of toxic training texts: term, words around it, text, and under the term "" how many
    contexts a text has; of clean ones: term, how many texts have it."""
    clean: Counter = Counter()

    def rows(term: list, around: list, key: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(around, pa.string()), pa.array(key, pa.string()), pa.array(n, pa.int64())], ["term", "around", "key", "n"])

    for batch, _, _ in slices(batches):
        term, around, key, whole = [], [], [], []
        for text, toxic, own_key in zip(*(column(batch, c).to_pylist() for c in ("text", "label", "key")), strict=True):
            words = _WORD.findall((text or "").lower())
            if toxic:
                pairs = {(f"{b} {a}", t) for b, t, a in zip(["", *words], words, [*words[1:], ""], strict=False)}
                for b, t in pairs | {(b, t[:k] + "*") for b, t in pairs for k in STEMS if len(t) > k}:
                    term.append(t)
                    around.append(b)
                    key.append(own_key)
                whole.append((own_key, len(pairs)))
            else:
                own = set(words)
                clean.update(own | {t[:k] + "*" for t in own for k in STEMS if len(t) > k})
        yield rows(term, around, key, [0] * len(term))
        yield rows([""] * len(whole), [k for k, _ in whole], [k for k, _ in whole], [n for _, n in whole])
        if len(clean) > _KEPT:
            yield rows(list(clean), [None] * len(clean), [None] * len(clean), list(clean.values()))
            clean.clear()
    yield rows(list(clean), [None] * len(clean), [None] * len(clean), list(clean.values()))


def _featured(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    auto = _automaton(terms)
    for batch, _, _ in slices(batches):
        x = [features(t, auto) or [0.0] * 7 for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "label").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; the last coefficient is the bias and is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    r = np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + r, x.T @ (weight * (p - y)) + r @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents whose crc32(doc_id) mod 5 is not 0."""
    ship(docs.sparkSession)
    own = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    known = known.groupBy(F.coalesce(F.md5("text"), F.lit("")).alias("key"))  # at most `sample` labels
    known = work.save(known.agg(F.first("text").alias("text"), F.max("label").alias("label")), "labelled")
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sum(n for k, n in size.items() if k), size.get(0, 0)
    if not bad or not good:
        return Model(bias=5.0 if bad else -5.0)
    # A context counts for one of its texts, the one of the least key.
    pairs = known.mapInArrow(_contexts, "term string, around string, key string, n long").groupBy("term", "around").agg(F.min("key").alias("key"), F.sum("n").alias("n"))
    pairs = work.save(pairs, "contexts")
    new = pairs.filter("term <> '' and term not like '%*' and key is not null").groupBy("key").agg(F.count("*").alias("new"))
    texts = work.save(pairs.filter("term = ''").join(new, "key", "left").select("key", (F.coalesce("new", F.lit(0)) >= FRESH * F.col("n")).alias("fresh")), "texts")
    bad = max(1, texts.filter("fresh").count())
    # What is new in near copies counts as one more text.
    near = F.broadcast(texts.filter("not fresh").select("key", F.lit("near").alias("near")))
    terms = pairs.filter("term <> ''").join(near, "key", "left").groupBy("term").agg(F.countDistinct(F.coalesce("near", "key")).alias("bad"), F.sum("n").alias("good"), F.count("around").alias("contexts"))
    terms = work.save(terms.filter("bad > 0"), "terms")
    p = bad / (bad + good)
    ratio = (F.col("bad") + 0.5) / (bad + 1.0) / ((F.col("good") + 0.5) / (good + 1.0))
    n = F.col("bad") + F.col("good")
    # Likelihood ratio against the share of all documents, held against the number of terms tried.
    surprise = F.col("bad") * F.log(F.col("bad") / (n * p)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - p)))).otherwise(0.0)
    sure = terms.filter((ratio >= RATIO) & (F.col("contexts") >= CONTEXTS) & (F.length("term") >= 3) & (surprise >= np.log(max(terms.count(), 2))))
    stems = sure.filter("term like '%*'").select(F.col("term").alias("stem"))
    own = terms.filter("term not like '%*'")
    forms = own.filter("good = 0").withColumn("stem", F.explode(F.array(*(F.concat(F.substring("term", 1, k), F.lit("*")) for k in STEMS)))).join(F.broadcast(stems), "stem").select("term", "bad")
    found = sure.filter("term not like '%*'").select("term", "bad").unionByName(forms).distinct().orderBy(F.desc("bad"), "term")
    words = [r["term"] for r in found.collect()]
    work.drop(terms)
    work.drop(pairs)
    work.drop(texts)
    if not words:
        return Model()
    rows = known.mapInArrow(lambda it: _featured(it, words), "label int, x array<double>").groupBy("x", "label").agg(F.count("*").alias("n")).collect()  # at most `sample` rows
    # Two prior cases of five documents each: one plain use of a term is abuse, one quoted use is not.
    one = [1.0, np.log1p(1.0), 0.0, 0.0, 1.0, 0.0, 0.15]
    prior = [(one, 1, 5), ([0.0, np.log1p(0.25), 0.0, 0.0, 0.25, 1.0, 0.15], 0, 5)]
    x = np.array([list(r["x"]) for r in rows] + [p[0] for p in prior])
    y = np.array([float(r["label"] > 0) for r in rows] + [p[1] for p in prior])
    w = logistic(x, y, np.array([r["n"] for r in rows] + [p[2] for p in prior], float))
    work.drop(known)
    return Model(words, w[:-1].tolist(), float(w[-1]))


def _values(batch: pa.RecordBatch, model: Model, auto: Automaton, w: np.ndarray) -> np.ndarray:
    x = np.zeros((batch.num_rows, 7))
    for i, t in enumerate(column(batch, "text").to_pylist()):
        if got := features(t, auto):
            x[i] = got
    return 1 / (1 + np.exp(-np.clip(x @ w + model.bias, -30, 30)))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    auto, w = _automaton(model.terms), np.array(model.weights)
    for batch, _, _ in slices(batches):
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(_values(batch, model, auto, w))], ["doc_id", "score"])


def _passed(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    auto, w = _automaton(model.terms), np.array(model.weights)
    for batch, _, _ in slices(batches):
        yield batch.filter(pa.array(_values(batch, model, auto, w) < 0.5))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def screen(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose score is below 0.5."""
    ship(docs.sparkSession)
    return docs.mapInArrow(lambda it: _passed(it, model), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learned from `labels`."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
