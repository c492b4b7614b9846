"""op4's trees against an exhaustive search, their SQL against walking them, and forms that no example holds."""

from __future__ import annotations

import math
import random

import pytest

from provena.llm import op4_pii as op

from .conftest import SCHEMA, make


def data(seed, n=120):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        x = tuple(rng.randint(0, 3) for _ in op.FEATURES)
        rows[x, int(rng.random() < (0.9 if x[1] + x[2] > 3 else 0.15))] = rng.choice([0.5, 1.0, 2.0, 7.0])
    return sorted((x, y, w) for (x, y), w in rows.items())


def brute_tree(rows, g, h, own, depth):
    """All cuts of all features by sums over the rows."""
    sums = lambda k: (sum(g[i] for i in k), sum(h[i] for i in k))
    gain = lambda k: sums(k)[0] ** 2 / (sums(k)[1] + op.RIDGE)
    leaf = round(-op.RATE * sums(own)[0] / (sums(own)[1] + op.RIDGE), 6)
    best = (1e-6, None)
    for f in range(len(op.FEATURES)) if depth else ():
        for cut in sorted({rows[i][0][f] for i in own})[:-1]:
            a, b = [i for i in own if rows[i][0][f] <= cut], [i for i in own if rows[i][0][f] > cut]
            if (won := gain(a) + gain(b) - gain(own)) > best[0] + 1e-12:
                best = (won, (f, cut, a, b))
    if best[1] is None:
        return leaf
    f, cut, a, b = best[1]
    return f, cut, brute_tree(rows, g, h, a, depth - 1), brute_tree(rows, g, h, b, depth - 1)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 2e-6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_against_exhaustive_search(seed):
    rows = data(seed)
    trees, margin = op.grow(rows), [0.0] * len(rows)
    assert len(trees) == op.TREES
    for t in trees[:6]:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [w * (q - y) for (_, y, w), q in zip(rows, p, strict=True)]
        h = [w * q * (1 - q) for (_, _, w), q in zip(rows, p, strict=True)]
        assert same(t, brute_tree(rows, g, h, list(range(len(rows))), op.DEPTH))
        margin = [m + op.walk(t, x) for m, (x, _, _) in zip(margin, rows, strict=True)]
    loss = lambda ms: sum(w * math.log(1 + math.exp(-m if y else m)) for m, (_, y, w) in zip(ms, rows, strict=True))
    assert loss([sum(op.walk(t, x) for t in trees) for x, _, _ in rows]) < 0.8 * loss([0.0] * len(rows))


def test_sql_of_trees_equals_walking(spark):
    rows = data(7)
    trees = op.grow(rows)
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(rows)], "id long, x struct<" + ",".join(f"{f}:int" for f in op.FEATURES) + ">")
    got = df.selectExpr("id", "struct(x as q) as z").selectExpr("id", f"{' + '.join(map(op._case, trees))} as score").collect()
    assert all(abs(r.score - sum(op.walk(t, rows[r.id][0]) for t in trees)) < 1e-9 for r in got)


PLANTED = ["fax 0171/5550123 please", "mobile: (555) 867-5309", "write jane_roe [at] mail (dot) example (dot) net", "iban DE89370400440532013000 for rent", "Tel. 555 0100 4477", "reach me on tel 0711 482 9910", "phone: 212.555.0188", "account iban FR1420041010050500013M02606", "mail max.muster (at) firma (dot) de", "tel: 0049-89-636-48018"]
HARMLESS = ["order 555-867-5309 shipped", "see pages 120-134 and 1999-2003", "isbn 978-3-16-148410-0", "version 10.2.33 of 2024", "article 20 7946 0958", "look at home (dot) matrix"]


def test_forms_that_no_example_holds(spark):
    known = {x for forms, _, _ in op.EXAMPLES for x in forms}
    assert not any(f in text for f in known for text in PLANTED)
    got = {r.doc_id: len(r.spans) for r in op.find(spark.createDataFrame(make(PLANTED + HARMLESS), SCHEMA)).collect()}
    found, wrong = [k for k in range(len(PLANTED)) if got[k]], [k for k in range(len(PLANTED), len(got)) if got[k]]
    assert len(found) >= len(PLANTED) - 1 and not wrong, (found, wrong)  # a number with a slash is no candidate
