"""op13: against brute force on awkward rows, and with hashes that collide."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from provena.llm import bytes_, op13_audit

from .conftest import SCHEMA, make, words


def failures(text: str) -> set[str]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    return out


def brute(rows, labels):
    """Each order is played through, document by document."""
    first, good, toxic = {}, {}, {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good[i], toxic[i] = good.get(i) or q == 1, toxic.get(i) or x == 1
    docs = []
    for i, t, lang, *_ in rows:
        f = failures(t or "")
        if i is not None and i > first[t or ""]:
            f.add("E")
        docs.append((lang or "", f, bool(good.get(i)), bool(toxic.get(i))))
    out, shares = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = list(range(len(docs)))
        for step, f in enumerate(order, 1):
            gone = [k for k in left if f in docs[k][1]]
            stay = [k for k in left if f not in docs[k][1]]
            for part in {d[0] for d in docs}:
                here = lambda ks: [docs[k] for k in ks if docs[k][0] == part]  # noqa: B023, E731
                own = here(gone)
                again = [d for k, d in enumerate(docs) if d[0] == part and f in d[1] and k not in left]
                out[part, order, step] = [len(here(stay)), len(own), len(again), sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in own), sum(d[3] for d in own)]
                shares[part, f] += len(own)
            left = stay
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_every_order(spark, awkward, labels):
    want = brute([tuple(r) for r in awkward.collect()], [tuple(r) for r in labels.collect()])
    assert len(want) == 120 * 5 * 3  # en, de and none
    assert got(op13_audit.audit(awkward, labels)) == want


def test_copies_of_repeated_ids(spark, labels):
    rows = make(["same text"] * 6 + ["Other TEXT #", "Other TEXT #"], [4, 4, 2, 2, 9, None, 1, 0], ["en"] * 8)
    d = spark.createDataFrame(rows, SCHEMA)
    assert got(op13_audit.audit(d, labels)) == brute(rows, [tuple(r) for r in labels.collect()])
    flags = Counter((r.id, r.mask & 16) for r in op13_audit.masks(d).collect() for _ in range(r.n))
    assert flags == {(4, 16): 2, (2, 0): 2, (9, 16): 1, (None, 0): 1, (1, 16): 1, (0, 0): 1}


def test_nothing(nothing, no_labels):
    assert op13_audit.audit(nothing, no_labels).collect() == []


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_colliding_hashes_change_no_count(monkeypatch, bits):
    import random

    rng = random.Random(bits)
    texts = [words(rng, n) + " " + words(rng, 3) * 2 for n in (0, 1, 5, 300)] + ["", "a b a b c", "aa ab aa", "x"]
    raw = [t.encode() for t in texts]
    real = bytes_.Words.hashes
    monkeypatch.setattr(bytes_.Words, "hashes", lambda self, fold=False: real(self, fold) & np.uint64((1 << bits) - 1))
    off = np.cumsum([0, *map(len, raw)])
    w = bytes_.Words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert op13_audit.distinct_words(w, len(texts)).tolist() == [len(set(t.split())) for t in texts]
