"""op11: base scores by brute force, the sampler against seating customer by customer, scores that sum to one."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from provena.llm import op11_pitman_yor as op

from .conftest import SCHEMA, make, words


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def base(rows):
    c = Counter(w for i, t, *_ in rows if learned(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return Counter((i, i is not None and not learned(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)) if v else 0.0, 6)) for i, t, *_ in rows)


def counts(df):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def context(w):
    """Of the token after w; None begins a text."""
    raw = w.encode() if w else b""
    return op._GROUP[raw[-1]] * op.GROUPS + (op._GROUP[raw[-2]] if len(raw) > 1 else op._NONE) if raw else op._NONE * op.GROUPS + op._NONE


def test_base_of_awkward_rows(spark, awkward):
    assert counts(op.score(awkward)) == base([tuple(r) for r in awkward.collect()])


@pytest.mark.parametrize("together", [256, 1])
def test_many_blocks(spark, monkeypatch, together):
    """Words counted in several blocks and salts; copies of a text score alike wherever they lie."""
    monkeypatch.setattr(op, "TOGETHER", together)
    rng = random.Random(3)
    some = [words(rng, n) for n in range(0, 120, 3)]
    rows = make([*some, *some, "of the " * 400, None, ""])
    got = op.score(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
    by = defaultdict(set)
    for r in got:
        by[rows[r.doc_id][1] or ""].add(round(r.score, 6))
        assert r.score < 0
    assert all(len(x) == 1 for x in by.values())


def test_nothing(spark, nothing):
    assert op.score(nothing).collect() == []
    got = op.score(spark.createDataFrame(make(["a b", None], [None, None]), SCHEMA)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_stirling_numbers():
    d, s = 0.8, op.Stirling(0.8)
    exact = {(1, 1): 1.0}
    for c in range(1, 40):
        for t in range(1, c + 2):
            exact[c + 1, t] = exact.get((c, t - 1), 0.0) + (c - d * t) * exact.get((c, t), 0.0)
    for c in (2, 5, 17, 40):
        for t in range(1, c + 1):
            want = math.log(exact[c, t] / exact[c, 1]) + math.lgamma(t) + (t - 1) * math.log(d)
            assert abs(s.small[c, t - 1] - want) < 1e-9
    # beyond the exact range: the same recursion, carried on
    c0, c1 = op.EXACT, 4 * op.EXACT
    t = np.arange(1, 400)
    row = s.rows[c0][:399] - np.array([math.lgamma(x) for x in t]) - (t - 1) * math.log(d)
    for c in range(c0, c1):
        row = np.logaddexp(np.concatenate([[-np.inf], row[:-1]]), row + np.log(c - d * t))
        row -= math.log(c)
    want = row - row[0] + np.array([math.lgamma(x) for x in t]) + (t - 1) * math.log(d)
    assert np.abs(s.delta(np.array([c1]), t.astype(float))[0] - want)[:200].max() < 0.05


@pytest.mark.parametrize(("c", "h", "rest"), [(2, 0.3, 4), (6, 0.05, 20), (30, 0.4, 9), (90, 0.1, 60), (300, 0.02, 200)])
def test_tables_against_seating_customers(c, h, rest):
    """The conditional of the number of tables: mean over draws, and over Gibbs sweeps that unseat and seat
    one customer after another."""
    rng = random.Random(c)
    d, theta = op.DISCOUNT, op.STRENGTH
    tables, seen = [1] * c, []
    for sweep in range(1200 if c < 50 else 500):
        for _ in range(c):
            k = rng.choices(range(len(tables)), tables)[0]
            tables[k] -= 1
            if not tables[k]:
                tables.pop(k)
            weight = [x - d for x in tables] + [(theta + d * (rest + len(tables))) * h]
            k = rng.choices(range(len(weight)), weight)[0]
            if k == len(tables):
                tables.append(1)
            else:
                tables[k] += 1
        if sweep >= 100:
            seen.append(len(tables))
    n = 4000
    got = op.draw_tables(np.full(n, c), np.full(n, h), np.full(n, rest), op.Stirling(), np.random.default_rng(1))
    assert got.min() >= 1 and got.max() <= c
    assert abs(got.mean() - np.mean(seen)) < 0.06 * np.mean(seen) + 0.1
    assert abs(got.std() - np.std(seen)) < 0.2 * np.std(seen) + 0.1


def entries(docs):
    """Counts by word and context, as the operator's rows."""
    count = Counter((w, context(p)) for d in docs for p, w in zip([None, *d], d, strict=False))
    names = sorted({w for w, _ in count}, key=str)
    own, first = [], [0]
    for w in names:
        own += [k | n << 10 for (x, k), n in sorted(count.items(), key=lambda e: e[0][1]) if x == w]
        first.append(len(own))
    return names, np.array(first), np.array(own, np.int64)


def seated(first, own, seed=0):
    """One process and all words: rounds as in the operator."""
    s, rng = op.Stirling(), np.random.default_rng(seed)
    x = op.Seating(first, own)
    for _ in range(8):
        g = op.Totals(np.bincount(x.context, x.t2, op.CONTEXTS), np.bincount(x.parent, x.t1, op.GROUPS), x.t0.sum(), np.bincount(x.context, x.c2, op.CONTEXTS), len(first) - 1)
        x.sweep(g, s, rng)
    return x, op.Totals(np.bincount(x.context, x.t2, op.CONTEXTS), np.bincount(x.parent, x.t1, op.GROUPS), x.t0.sum(), np.bincount(x.context, x.c2, op.CONTEXTS), len(first) - 1)


def test_probabilities_sum_to_one():
    rng = random.Random(8)
    names, first, own = entries([tokens(words(rng, 80)) for _ in range(30)])
    x, g = seated(first, own)
    whole = g.t2.sum(), g.t1.sum()
    assert whole == (x.c1.sum(), x.c0.sum()) and g.t0 <= whole[1]
    root = x.root(g, x.c0, x.t0)
    unknown = x.root(g, np.zeros(1), np.zeros(1))[0]
    assert abs(root.sum() + unknown - 1) < 1e-9
    for k in np.unique(x.context)[:20].tolist():
        parent = k // op.GROUPS
        p1 = {w: op.Seating.middle(x, g, np.array([parent]), np.zeros(1), np.zeros(1), np.array([root[w]]))[0] for w in range(len(names))}
        for at in np.flatnonzero(x.parent == parent):
            p1[x.pair_word[at]] = op.Seating.middle(x, g, x.parent[[at]], x.c1[[at]], x.t1[[at]], root[[x.pair_word[at]]])[0]
        new = op.STRENGTH + op.DISCOUNT * g.t2[k]
        p2 = {w: new * p / (op.STRENGTH + g.c2[k]) for w, p in p1.items()}
        p = x.predictive(g)
        for e in np.flatnonzero(x.context == k):
            p2[x.word[e]] = p[e]
        none = op.Seating.middle(x, g, np.array([parent]), np.zeros(1), np.zeros(1), np.array([unknown]))[0] * new / (op.STRENGTH + g.c2[k])
        assert abs(sum(p2.values()) + none - 1) < 1e-9


def test_scores_against_one_process(spark):
    """The job's scores are near those of one process that seats all words together."""
    rng = random.Random(12)
    vocabulary = [words(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(5, 60))) for _ in range(150)]
    rows = make(texts)
    names, first, own = entries([tokens(t) for i, t, *_ in rows if learned(i)])
    x, g = seated(first, own)
    p = {(names[w], k): v for w, k, v in zip(x.word.tolist(), x.context.tolist(), x.predictive(g).tolist(), strict=True)}
    want, got = 0.0, 0.0
    for r in op.score(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        d = tokens(rows[r.doc_id][1])
        if learned(r.doc_id):
            mine = sum(math.log10(p[w, context(q)]) for q, w in zip([None, *d], d, strict=False))
            assert abs(r.score - mine) < 0.15 * abs(mine) + 0.5
            want, got = want + mine, got + r.score
        assert r.score > 1.6 * r.base_score
    assert abs(got - want) < 0.02 * abs(want)


def test_held_out_text_is_likelier_than_its_base_score(spark):
    r = op.query(spark, "/root/testdata/sf0.01").groupBy("held_out").sum("score", "base_score").collect()
    assert all(x["sum(score)"] > 0.95 * x["sum(base_score)"] for x in r)


def test_restaurants_of_whole_words(spark):
    """Words that end alike have restaurants of their own: what follows one is not likely after the other."""
    rng = random.Random(4)
    after = {"walking": ["alpha", "beta"], "talking": ["gamma", "delta"]}
    texts = [" ".join(f"{w} {rng.choice(after[w])}" for w in rng.choices(["walking", "talking"], k=10)) for _ in range(60)]
    held = [i for i in range(400) if not learned(i)]
    texts = [*texts, *([None] * 400)]
    texts[held[-1]], texts[held[-2]] = "walking alpha walking beta", "walking gamma walking delta"
    r = {x.doc_id: x.score for x in op.score(spark.createDataFrame(make(texts), SCHEMA).repartition(3)).collect()}
    assert r[held[-1]] > r[held[-2]] + 2  # equal but for the words' own restaurants


def pairs(docs):
    """A bucket that holds all pairs of (word before, word), as the operator's row, and the words' hashes."""
    text = pa.table({"block": [0] * len(docs), "learn": [True] * len(docs), "text": docs})
    return op.Pairs(op._united(op._counted(text, 1), "block").slice(0, 1))


def test_probabilities_after_a_word_sum_to_one():
    rng = random.Random(9)
    x = pairs([words(rng, 80) for _ in range(30)])
    x.seat()
    s, gen = op.Stirling(), np.random.default_rng(0)
    totals = lambda y: op.Totals(np.bincount(y.context, y.t2, op.CONTEXTS), np.bincount(y.parent, y.t1, op.GROUPS), y.t0.sum(), np.bincount(y.context, y.c2, op.CONTEXTS), len(x.words))
    for _ in range(4):
        of = np.bincount(np.unique(x.before, return_inverse=True)[1], x.t)[np.unique(x.before, return_inverse=True)[1]].astype(int)
        x.rest = (of - x.t)[x.many]
        x.sweep(totals(x.seats), s, gen)
    y, g = x.seats, totals(x.seats)
    assert y.c2.sum() == x.t.sum() and (x.t >= 1).all() and (x.t <= x.c).all()
    root = y.root(g, y.c0, y.t0)
    for u in np.unique(x.before)[:10]:
        own = np.flatnonzero(x.before == u)
        k = y.context[x.above[own[0]]]
        parent = k // op.GROUPS
        base = np.append(root, y.root(g, np.zeros(1), np.zeros(1)))  # the last is the unknown word
        p1 = y.middle(g, np.array([parent]), np.zeros(1), np.zeros(1), base)
        at = np.flatnonzero(y.parent == parent)
        p1[y.pair_word[at]] = y.middle(g, y.parent[at], y.c1[at], y.t1[at], root[y.pair_word[at]])
        p2 = (op.STRENGTH + op.DISCOUNT * g.t2[k]) * p1 / (op.STRENGTH + g.c2[k])
        at = np.flatnonzero(y.context == k)
        p2[y.word[at]] = y.predictive(g)[at]
        p3 = (op.STRENGTH + op.DISCOUNT * x.t[own].sum()) * p2
        p3[np.repeat(np.arange(len(x.words)), np.diff(x.first))[own]] += x.c[own] - op.DISCOUNT * x.t[own]
        assert abs(p3.sum() / (op.STRENGTH + x.c[own].sum()) - 1) < 1e-9


def test_bytes_of_what_is_sent():
    """What a block sends, and what is sent back, takes less than eight bytes for each (word, word before)."""
    rng = random.Random(6)
    vocabulary = [words(rng, 1) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=2000)) for _ in range(100)]
    text = pa.table({"block": [0] * len(texts), "learn": [True] * len(texts), "text": texts})
    sent = op._counted(text, 8)
    n = sum(int(op._all(r, "size", "<u4").sum()) for r in (sent.slice(i, 1) for i in range(8)))
    assert n == len({(w, p) for t in texts for w, p in zip(tokens(t), [None, *tokens(t)], strict=False)})
    assert sum(sent.column(c).nbytes for c in op._MODEL) < 8 * n
    size = len(np.unique(op.tokens(*op.buffers(text.column("text")))[1]))
    known = pa.table({"n": op._whole(np.arange(size) % 9, "<i8"), "t": op._whole(np.arange(size) % 7, "<f4"), "a": op._whole(np.full(n, 0.2), "<f4"), "p": op._whole(np.random.default_rng(1).random(n), "<f4")})
    routes = op._united(op._counted(text, 1), "block").slice(1, 1)
    answers = op._answered(routes, known)
    assert (op._all(answers, "p", "<f4") == op._all(known, "p", "<f4")).all()
    assert sum(answers.column(c).nbytes for c in "ntap") < 8 * n


def test_packed_values():
    for kind in ("<u4", "<u8", "<f8"):
        values, first = np.array([7, 1, 2**31, 0, 5]).astype(kind), np.array([0, 2, 2, 5])
        got, at = op._values(op._binary(values, first).slice(1), kind)
        assert got.tolist() == values[2:].tolist() and at.tolist() == [0, 0, 3]
    at, first = np.array([2**63, 2**64 - 1, 0, 3], np.uint64), np.array([0, 2, 4])
    assert op._places(pa.table({"x": op._binary(op._steps(at, first, "<u8"), first)}), "x", "<u8")[0].tolist() == at.tolist()


@pytest.mark.parametrize("together", [256, 1])
def test_turns(spark, monkeypatch, together):
    """Scores are the same in one turn and in several; no setting is left behind."""
    monkeypatch.setattr(op, "TOGETHER", together)
    rng = random.Random(7)
    docs = spark.createDataFrame(make([words(rng, n) for n in range(40)]), SCHEMA).repartition(5, "doc_id").localCheckpoint()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given, got = spark.conf.get(name), []
    for turns in (1, 3):
        monkeypatch.setattr(op, "TURNS", turns)
        got.append(sorted(tuple(r) for r in op.score(docs).collect()))
    assert got[0] == got[1] and len(got[0]) == 40 and spark.conf.get(name) == given
