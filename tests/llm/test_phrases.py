"""op12: against brute force, with common heads dealt out, colliding hashes and counts beyond 64 bits."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from provena.llm import op12_phrases as op

from .conftest import SCHEMA, make


def brute(rows, longest=3, least=10, absorbs=50, first=2000):
    count = Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            count[lang, ()] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        cuts = [(1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(m == lang and len(q) > len(p) and 100 * b >= absorbs * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in found.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, r, count[lang, ()], -s) for lang, own in out.items() for rank, (s, a, p, x, r) in enumerate(sorted(own)[:first], 1))


def got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=500):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "a", "é", "ß", "中文", "İ", "x1", " ", "#", "I"]
    texts = []
    for _ in range(n):
        t = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\t", "!?", " \t", "\x0b", ":;"]) for _ in range(rng.randint(0, 60)))
        texts.append(t + rng.choice(["", " new york city", " NEW York\tcity hall"]))
    return make([*texts, None, "", " \t", texts[0], texts[0], "of the " * 200], None)


@pytest.mark.parametrize(("longest", "least", "absorbs", "first"), [(3, 10, 50, 2000), (5, 3, 80, 7), (2, 2, 50, 50)])
def test_brute_force(spark, longest, least, absorbs, first):
    rows = corpus(longest)
    want = brute(rows, longest, least, absorbs, first)
    assert len(want) > 15 and got(op.phrases(spark.createDataFrame(rows, SCHEMA), longest, least, absorbs, first)) == want


def test_common_heads_change_no_count(spark):
    docs = spark.createDataFrame(corpus(9), SCHEMA)
    some = op.common_heads(docs)
    assert some and ("en", "of the") in some | {("en", "of the")}
    plain = sorted(tuple(r) for r in op.counts(docs, 4).collect())
    assert sorted(tuple(r) for r in op.counts(docs, 4, 1, some).collect()) == plain
    every = {(r[0], r[1]) for r in plain}
    assert sorted(tuple(r) for r in op.counts(docs, 4, 1, every).collect()) == plain


def test_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.collect()]
    assert got(op.phrases(awkward, 3, 2)) == brute(rows, 3, 2)
    assert op.phrases(nothing).collect() == []


def test_colliding_hashes(monkeypatch):
    words = [b"ab", b"c", b"ab", b"cd", b"c", b"b"]
    monkeypatch.setattr(op, "segment_hashes", lambda data, sizes, fold=False: np.zeros(len(sizes), np.uint64))
    ids, names, _ = op._numbered(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert names.to_pylist() == ["ab", "b", "c", "cd"] and ids.tolist() == [0, 2, 0, 3, 2, 1]


def test_scores_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = rng.randint(10, 10**15)
        rows.append((a, a + rng.randint(0, a), a + rng.randint(0, 3 * a)))
    d = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{op.score('a', 'l', 'r')} as s")
    assert all(x.s == 1000000 * x.a * x.a // (x.l * x.r) for x in d.collect())
