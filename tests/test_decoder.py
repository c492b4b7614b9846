from __future__ import annotations

import numpy as np

from provena.operators import decoder

G = decoder.Geometry(vocab=11, width=8, layers=2, heads=4, kv_heads=2, hidden=6)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    p, tokens = decoder.initial(G, 1), rng.integers(0, 11, 9)
    _, grad = decoder.loss_and_gradient(p, G, tokens)
    for k in p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            was, got = p[k][at], []
            for d in (1e-5, -1e-5):
                p[k][at] = was + d
                got.append(decoder.loss_and_gradient(p, G, tokens)[0])
            p[k][at] = was
            assert abs((got[0] - got[1]) / 2e-5 - grad[k][at]) < 1e-7, (k, at)


def test_windows_and_sums(spark):
    df = spark.createDataFrame([(i, i * 7 % 11) for i in range(35)], "pos long, tok long")
    w = decoder.token_windows(df, "pos", "tok", 8)
    rows = {r.window: r.tokens for r in w.collect()}
    assert rows == {k: [i * 7 % 11 for i in range(8 * k, 8 * k + 9)] for k in range(4)}
    p = decoder.initial(G, 2)
    want = {k: np.zeros_like(v) for k, v in p.items()}
    loss = 0.0
    for t in rows.values():
        one, grad = decoder.loss_and_gradient(p, G, np.array(t))
        loss += one
        for k, v in grad.items():
            want[k] += v
    got = decoder.gradients(w.repartition(3), p, G).collect()
    assert len(got) == sum(len(v) for v in p.values())
    for r in got:
        assert np.allclose(r.g, want[r.slot][r.r]) and r.windows == 4 and abs(r.loss - loss) < 1e-9


def test_training_lowers_the_loss(spark):
    df = spark.createDataFrame([(i, i * 7 % 11) for i in range(40)], "pos long, tok long")
    w = decoder.token_windows(df, "pos", "tok", 8).cache()
    _, losses = decoder.train(w, decoder.initial(G, 3), G, 4, lr=0.02)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] - 0.1
