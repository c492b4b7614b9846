"""A decoder-only model's loss and gradient, data-parallel over token windows.

The model (RMS norms, rotary embedding in half-split layout, grouped-query causal attention, SwiGLU,
tied head, mean cross-entropy) is broadcast: its size is the geometry's, whatever the data. Each task
runs forward and backward passes over its windows as numpy blocks and sends one partial sum for each row
of each parameter; Spark adds these, so a step shuffles the model once for each task and no window.
Backward passes are the written-out derivatives of each operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources import shared


@dataclass(frozen=True)
class Geometry:
    vocab: int
    width: int
    layers: int
    heads: int
    kv_heads: int
    hidden: int
    theta: float = 10000.0
    eps: float = 1e-5

    @property
    def head(self) -> int:
        return self.width // self.heads


def shapes(g: Geometry) -> dict[str, tuple[int, ...]]:
    """Slots and shapes, in key order."""
    kv = g.kv_heads * g.head
    out: dict[str, tuple[int, ...]] = {"embed": (g.vocab, g.width), "norm": (1, g.width)}
    for i in range(g.layers):
        out |= {f"{i}.attn_norm": (1, g.width), f"{i}.ffn_norm": (1, g.width), f"{i}.q": (g.width, g.width), f"{i}.k": (kv, g.width), f"{i}.v": (kv, g.width), f"{i}.o": (g.width, g.width), f"{i}.gate": (g.hidden, g.width), f"{i}.up": (g.hidden, g.width), f"{i}.down": (g.width, g.hidden)}
    return dict(sorted(out.items()))


def initial(g: Geometry, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: np.ones(s) if "norm" in k else rng.normal(scale=s[1] ** -0.5, size=s) for k, s in shapes(g).items()}


def _norm(x, w, eps):
    r = 1 / np.sqrt((x * x).mean(-1, keepdims=True) + eps)
    return x * r * w, r


def _norm_back(dy, x, r, w):
    """(dx, dw) of x * r * w."""
    d = dy * w
    return r * d - x * r**3 * (d * x).mean(-1, keepdims=True), (dy * x * r).sum(0, keepdims=True)


def _turn(x):
    a, b = np.split(x, 2, -1)
    return np.concatenate([-b, a], -1)


def _heads(x, n):
    return x.reshape(len(x), n, -1).transpose(1, 0, 2)


def _flat(x):
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def loss_and_gradient(p: dict[str, np.ndarray], g: Geometry, tokens: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of one window's next tokens, and its gradient by every parameter."""
    ids, target = tokens[:-1], tokens[1:]
    n, group = len(ids), g.heads // g.kv_heads
    angle = np.arange(n)[:, None] * g.theta ** (-(np.arange(g.head) % (g.head // 2)) * 2.0 / g.head)
    cos, sin = np.cos(angle), np.sin(angle)
    mask = np.triu(np.full((n, n), -np.inf), 1)
    x, kept = p["embed"][ids], []
    for i in range(g.layers):
        w = {k: p[f"{i}.{k}"] for k in ("q", "k", "v", "o", "gate", "up", "down", "attn_norm", "ffn_norm")}
        h, r1 = _norm(x, w["attn_norm"], g.eps)
        q, k, v = _heads(h @ w["q"].T, g.heads), _heads(h @ w["k"].T, g.kv_heads), _heads(h @ w["v"].T, g.kv_heads)
        q, k = q * cos + _turn(q) * sin, k * cos + _turn(k) * sin
        kk, vv = np.repeat(k, group, 0), np.repeat(v, group, 0)
        s = q @ kk.transpose(0, 2, 1) / np.sqrt(g.head) + mask
        a = np.exp(s - s.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        o = _flat(a @ vv)
        y = x + o @ w["o"].T
        f, r2 = _norm(y, w["ffn_norm"], g.eps)
        u, t = f @ w["gate"].T, f @ w["up"].T
        sig = 1 / (1 + np.exp(-u))
        kept.append((w, x, h, r1, q, kk, vv, a, o, y, f, r2, u, t, sig))
        x = y + (u * sig * t) @ w["down"].T
    z, r = _norm(x, p["norm"], g.eps)
    logits = z @ p["embed"].T
    e = np.exp(logits - logits.max(-1, keepdims=True))
    prob = e / e.sum(-1, keepdims=True)
    loss = float(-np.log(prob[np.arange(n), target]).mean())

    grad = {k: np.zeros_like(v) for k, v in p.items()}
    d = prob
    d[np.arange(n), target] -= 1
    d /= n
    grad["embed"] += d.T @ z
    dx, grad["norm"] = _norm_back(d @ p["embed"], x, r, p["norm"])
    for i in reversed(range(g.layers)):
        w, x, h, r1, q, kk, vv, a, o, y, f, r2, u, t, sig = kept[i]
        act = u * sig * t
        dact = dx @ w["down"]
        du, dt = dact * t * (sig + u * sig * (1 - sig)), dact * u * sig
        dfx, dn = _norm_back(du @ w["gate"] + dt @ w["up"], y, r2, w["ffn_norm"])
        dy = dx + dfx
        do = _heads(dy @ w["o"], g.heads)
        da, dvv = do @ vv.transpose(0, 2, 1), a.transpose(0, 2, 1) @ do
        ds = a * (da - (da * a).sum(-1, keepdims=True)) / np.sqrt(g.head)
        dq, dkk = ds @ kk, ds.transpose(0, 2, 1) @ q
        dk, dv = (m.reshape(g.kv_heads, group, n, -1).sum(1) for m in (dkk, dvv))  # heads that share one
        back = lambda m: _flat(m * cos - _turn(m * sin))  # noqa: E731  the turn's transpose is its negative
        dq, dk, dv = back(dq), back(dk), _flat(dv)
        dhx, dm = _norm_back(dq @ w["q"] + dk @ w["k"] + dv @ w["v"], x, r1, w["attn_norm"])
        for k, m in (("down", dx.T @ act), ("gate", du.T @ f), ("up", dt.T @ f), ("ffn_norm", dn), ("o", dy.T @ o), ("q", dq.T @ h), ("k", dk.T @ h), ("v", dv.T @ h), ("attn_norm", dm)):
            grad[f"{i}.{k}"] = m
        dx = dy + dhx
    np.add.at(grad["embed"], ids, dx)  # the tied embedding's second share
    return loss, grad


def gradients(windows: DataFrame, params: dict[str, np.ndarray], g: Geometry) -> DataFrame:
    """(slot, r, g array, loss, windows): summed gradients by row of each slot, and on each row the
    summed loss and the number of windows. `windows` has one array column `tokens`."""
    spark = windows.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(params)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = {k: np.zeros_like(v) for k, v in held.value.items()}, 0.0, 0
        for b in batches:
            for tokens in b.column(0).to_pylist():
                one, grad = loss_and_gradient(held.value, g, np.array(tokens))
                loss, n = loss + one, n + 1
                for k, v in grad.items():
                    total[k] += v
        if n:
            for k, v in total.items():
                off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(v)), pa.array(np.arange(len(v))), pa.ListArray.from_arrays(off, pa.array(v.ravel())), pa.array([loss] * len(v)), pa.array([n] * len(v), pa.int64())], ["slot", "r", "g", "loss", "windows"])

    parts = windows.select("tokens").mapInArrow(part, "slot string, r long, g array<double>, loss double, windows long")
    sums = parts.groupBy("slot", "r").agg(F.sum("loss").alias("loss"), F.sum("windows").alias("windows"))
    added = parts.select("slot", "r", F.posexplode("g")).groupBy("slot", "r", "pos").agg(F.sum("col").alias("x"))  # partial sums before the shuffle
    rows = added.groupBy("slot", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("g"))  # one row of a parameter
    return rows.join(sums, ["slot", "r"]).select("slot", "r", "g", "loss", "windows")


def token_windows(tokens: DataFrame, position: str, token: str, size: int) -> DataFrame:
    """(window, tokens): the `size` + 1 tokens from each multiple of `size`; incomplete ones are left out."""
    at = F.floor(F.col(position) / size)
    first = tokens.select(at.alias("window"), F.col(position).alias("pos"), F.col(token).alias("tok"))
    shared = first.filter(F.col("pos") % size == 0).select((F.col("window") - 1).alias("window"), "pos", "tok")  # also the last target of the window before
    g = first.unionByName(shared).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t"))
    return g.filter(F.size("t") == size + 1).select("window", F.transform("t", lambda s: s["tok"].cast("int")).alias("tokens"))


def table_of(spark: SparkSession, params: dict[str, np.ndarray]) -> DataFrame:
    """(slot, r, w, m, v): parameters by row, with zero moments."""
    rows = [(k, r, row.tolist(), [0.0] * len(row), [0.0] * len(row)) for k, x in params.items() for r, row in enumerate(x)]
    return spark.createDataFrame(rows, "slot string, r long, w array<double>, m array<double>, v array<double>")


def train(windows: DataFrame, params: dict[str, np.ndarray], g: Geometry, steps: int, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.95, eps: float = 1e-8, decay: float = 0.0) -> tuple[dict[str, np.ndarray], list[float]]:
    """Full-batch AdamW with the gradient norm clipped to 1. Parameters and moments are a table, a step is a
    join with the summed gradients, and only the parameters come back for the next broadcast. Returns
    them and the loss before each step."""
    spark = windows.sparkSession
    state, losses = table_of(spark, params), []
    each = lambda f, *cols: F.transform(F.arrays_zip(*cols), f)
    for t in range(1, steps + 1):
        path = shared.folder(spark, "train")
        gradients(windows, params, g).select("slot", "r", F.transform("g", lambda x: x / F.col("windows")).alias("g"), (F.col("loss") / F.col("windows")).alias("loss")).write.parquet(f"{path}/g")
        grad = spark.read.parquet(f"{path}/g")
        whole = grad.agg(F.sqrt(F.sum(F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), F.max("loss").alias("loss")).first()  # one row
        losses.append(whole["loss"])
        clip = min(1.0, 1 / (whole["norm"] + 1e-6))
        both = state.join(grad, ["slot", "r"]).withColumn("m", each(lambda z: beta1 * z["m"] + (1 - beta1) * clip * z["g"], "m", "g")).withColumn("v", each(lambda z: beta2 * z["v"] + (1 - beta2) * clip * clip * z["g"] * z["g"], "v", "g"))
        w = each(lambda z: z["w"] - lr * decay * z["w"] - lr * (z["m"] / (1 - beta1**t)) / (F.sqrt(z["v"] / (1 - beta2**t)) + eps), "w", "m", "v")
        both.select("slot", "r", w.alias("w"), "m", "v").write.parquet(f"{path}/state")
        state = spark.read.parquet(f"{path}/state")
        params = {k: np.empty_like(x) for k, x in params.items()}
        for r in state.select("slot", "r", "w").toLocalIterator():  # the model's rows
            params[r["slot"]][r["r"]] = r["w"]
    return params, losses
