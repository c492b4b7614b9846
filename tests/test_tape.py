"""Products of tiles, and gradients on the tape against central differences of a plain numpy forward pass."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.operators import tape, tiles


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")


def back(x, shape, height, width):
    out = np.full(shape, np.nan)
    for r in tiles.to_long(x, height, width).collect():
        assert np.isnan(out[r.r, r.c])  # each value once
        out[r.r, r.c] = r.x
    return out


@pytest.mark.parametrize("each", [256, 2])
def test_products(spark, monkeypatch, each):
    monkeypatch.setattr(tiles, "EACH", each)
    rng = np.random.default_rng(each)
    a, b, c = rng.normal(size=(23, 10)), rng.normal(size=(7, 10)), rng.normal(size=(23, 7))
    ta, tb, tc = (tiles.from_rows(rows(spark, x), "k", "v", 4, 3) for x in (a, b, c))
    assert np.allclose(back(ta, a.shape, 4, 3), a)
    # (i, j) blocks of b are of 4 x 3; those of c's columns must match b's rows
    tc = tiles.from_rows(rows(spark, c), "k", "v", 4, 4)
    assert np.allclose(back(tiles.product_nt(ta, tb), c.shape, 4, 4), a @ b.T)
    assert np.allclose(back(tiles.product_nn(tc, tb), a.shape, 4, 3), c @ b)
    assert np.allclose(back(tiles.product_tn(tc, ta), b.shape, 4, 3), c.T @ a)
    assert tiles.product_nt(ta, tb).select("i", "j").distinct().count() == 6 * 2


def test_a_salted_product_spreads_one_inner_block(spark, monkeypatch):
    monkeypatch.setattr(tiles, "EACH", 4)
    x = tiles.from_rows(rows(spark, np.ones((64, 3))), "k", "v", 1, 3)
    assert tiles._salts(x, "j") == 16
    both = tiles._joined(x, tiles.from_rows(rows(spark, np.ones((2, 3))), "k", "v", 2, 3), ("j", "j"), "i")
    assert both.groupBy("inner", "salt").count().agg(F.max("count")).first()[0] == 4


def test_rows_with_gaps_fail(spark):
    with pytest.raises(Exception, match="gaps"):
        tiles.from_rows(rows(spark, np.ones((5, 2))).filter("k <> 2"), "k", "v", 4, 2).collect()


WINDOW, HEAD, WIDTH, HIDDEN, CLASSES = 4, 4, 8, 6, 5


def plain(p, x, target):
    """The same dataflow as `taped`, on whole matrices."""

    def norm(v):
        return v / np.sqrt((v * v).mean(1, keepdims=True) + 1e-5)

    def rotate(v):
        out = np.empty_like(v)
        for h in range(0, v.shape[1], HEAD):
            a, b = np.hsplit(v[:, h : h + HEAD], 2)
            at = np.arange(len(v))[:, None] * 10000.0 ** -(np.arange(HEAD // 2) * 2 / HEAD)
            out[:, h : h + HEAD] = np.hstack([a * np.cos(at) - b * np.sin(at), b * np.cos(at) + a * np.sin(at)])
        return out

    h = norm(x)
    q, k, v = rotate(h @ p["q"].T), rotate(h @ p["k"].T), h @ p["v"].T
    a = np.zeros_like(q)
    for lo in range(0, len(x), WINDOW):
        w = slice(lo, lo + WINDOW)
        for n in range(WIDTH // HEAD):
            c = slice(n * HEAD, (n + 1) * HEAD)
            s = q[w, c] @ k[w].T / HEAD**0.5  # one key-value head for all
            s[np.triu_indices(len(s), 1)] = -np.inf
            e = np.exp(s - s.max(1, keepdims=True))
            a[w, c] = e / e.sum(1, keepdims=True) @ v[w]
    y = x + a @ p["o"].T
    f = norm(y)
    u, t = f @ p["gate"].T, f @ p["up"].T
    out = y + (u / (1 + np.exp(-u)) * t) @ p["down"].T
    z = out @ p["head"].T
    m = z.max(1, keepdims=True)
    return (np.log(np.exp(z - m).sum(1)) + m[:, 0] - z[np.arange(len(z)), target]).mean()


def test_gradients_by_central_differences(spark):
    rng = np.random.default_rng(5)
    shapes = {"q": (WIDTH, WIDTH), "k": (HEAD, WIDTH), "v": (HEAD, WIDTH), "o": (WIDTH, WIDTH), "gate": (HIDDEN, WIDTH), "up": (HIDDEN, WIDTH), "down": (WIDTH, HIDDEN), "head": (CLASSES, WIDTH)}
    p = {k: rng.normal(size=s) for k, s in shapes.items()}
    x, target = rng.normal(size=(10, WIDTH)), rng.integers(0, CLASSES, 10)
    t = tape.Tape(spark, WINDOW, HEAD)
    # column tiles of one head: norms, losses and products run over several of them; the last window is short
    tx = t.leaf(tiles.from_rows(rows(spark, x), "k", "v", WINDOW, HEAD))
    ty = t.leaf(tiles.from_rows(rows(spark, target[:, None].astype(float)), "k", "v", WINDOW, 1)).tiles
    w = {k: t.leaf(tiles.from_rows(rows(spark, v), "k", "v", HEAD, HEAD), k) for k, v in p.items()}
    h = t.norm(tx, WIDTH)
    a = t.attention(t.rotate(t.product(h, w["q"])), t.rotate(t.product(h, w["k"])), t.product(h, w["v"]), group=WIDTH // HEAD)
    y = t.add(tx, t.product(a, w["o"]))
    f = t.norm(y, WIDTH)
    out = t.add(y, t.product(t.swiglu(t.product(f, w["gate"]), t.product(f, w["up"])), w["down"]))
    loss = t.cross_entropy(t.product(out, w["head"]), ty, len(x), HEAD)
    assert abs(back(loss.tiles, (1, 1), 1, 1)[0, 0] - plain(p, x, target)) < 1e-12
    got = dict(zip([*w, "x"], t.gradients(loss, *w.values(), tx), strict=True))
    for name in [*w, "x"]:
        value = x if name == "x" else p[name]
        g = back(got[name], value.shape, WINDOW, HEAD)
        for at in zip(*(rng.integers(0, n, 6) for n in value.shape), strict=True):
            was, e = value[at], 1e-5
            value[at] = was + e
            up = plain(p, x, target)
            value[at] = was - e
            down = plain(p, x, target)
            value[at] = was
            assert abs((up - down) / (2 * e) - g[at]) < 1e-7, (name, at)


def test_training_lowers_the_loss_as_plain_steps_do(spark):
    """Two layers, decay by parameter, against numpy with its own gradients."""
    from provena.operators import training

    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(HIDDEN, WIDTH)) * 0.5, rng.normal(size=(CLASSES, HIDDEN)) * 0.5
    x, target = rng.normal(size=(14, WIDTH)), rng.integers(0, CLASSES, 14)
    decay = {"a": 0.0, "b": 0.2}

    def loss(t, p):
        tx = t.leaf(tiles.from_rows(rows(spark, x), "k", "v", WINDOW, HEAD))
        ty = t.leaf(tiles.from_rows(rows(spark, target[:, None].astype(float)), "k", "v", WINDOW, 1)).tiles
        h = t.product(tx, p["a"])
        return t.cross_entropy(t.product(t.swiglu(h, h), p["b"]), ty, len(x), HEAD)  # one tensor on both sides of a product

    start = {k: tiles.from_rows(rows(spark, v), "k", "v", HEAD, HEAD) for k, v in (("a", a), ("b", b))}
    states, seen = training.train(spark, start, loss, 2, WINDOW, HEAD, lr=0.05, decay=decay, most=0.5)

    w = {"a": a.copy(), "b": b.copy()}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x_) for k, x_ in w.items()}

    def forward(w):
        h = x @ w["a"].T
        z = (h * h / (1 + np.exp(-h))) @ w["b"].T
        top = z.max(1, keepdims=True)
        return (np.log(np.exp(z - top).sum(1)) + top[:, 0] - z[np.arange(len(z)), target]).mean()

    for n in (1, 2):
        assert abs(seen[n - 1][0] - forward(w)) < 1e-9
        g = {}
        for k in w:
            g[k] = np.zeros_like(w[k])
            for at in np.ndindex(w[k].shape):
                was = w[k][at]
                w[k][at] = was + 1e-5
                up = forward(w)
                w[k][at] = was - 1e-5
                g[k][at], w[k][at] = (up - forward(w)) / 2e-5, was
        norm = sum((d * d).sum() for d in g.values()) ** 0.5
        assert abs(norm - seen[n - 1][1]) < 1e-6
        for k in w:
            d = g[k] * min(1, 0.5 / (norm + 1e-6))
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.95 * v[k] + 0.05 * d * d
            w[k] = w[k] - 0.05 * decay[k] * w[k] - 0.05 * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.95**n)) + 1e-8)
    assert seen[1][0] < seen[0][0]
    for k in w:
        assert np.allclose(back(training.values(states[k]), w[k].shape, HEAD, HEAD), w[k], atol=1e-4)


def test_states_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.normal(scale=300, size=(3, 40))
    parts = [np.hstack([x[:, i : i + 5].max(1, keepdims=True), np.exp(x[:, i : i + 5] - x[:, i : i + 5].max(1, keepdims=True)).sum(1, keepdims=True)]) for i in range(0, 40, 5)]
    for order in (range(8), rng.permutation(8)):
        s = parts[order[0]]
        for i in list(order)[1:]:
            s = tape.softmax_state(s, parts[i])
        assert np.allclose(s[:, 0] + np.log(s[:, 1]), x.max(1) + np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)))


def test_a_product_is_made_and_merged_in_one_worker(spark):
    """Before the shuffle and after it, a task of a product has one Python worker."""
    e = spark.range(70).select("id", F.array(*(F.col("id") * k for k in range(6))).alias("vec"))
    x, w = tiles.from_rows(e, "id", "vec", 8, 2), tiles.from_rows(e.filter("id < 5"), "id", "vec", 8, 2)
    made = spark.createDataFrame(x.collect(), tiles.TILE), spark.createDataFrame(w.collect(), tiles.TILE)
    y = tiles.product_nt(*made)
    assert y._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    v = np.array([[i * k for k in range(6)] for i in range(70)], float)
    got = {(r.r, r.c): r.x for r in tiles.to_long(y, 8, 8).collect()}
    assert got == {(i, o): float(v[i] @ v[o]) for i in range(70) for o in range(5)}
