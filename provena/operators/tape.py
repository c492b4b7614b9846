"""Reverse-mode gradients of dataflows over tiles.

Every operator of a `Tape` computes its tiles by joins and numpy kernels, writes them once as a table (the
activation that the way back reads again), and records its inputs with a rule that turns the gradient of its result
into those of its inputs. `Tape.gradients` walks the records in reverse order; a tensor that fed several
operators gets the sum of what they send. Rows are grouped in tiles of one context window, so attention stays
inside a tile row; a column tile is one head.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from . import tiles
from .tiles import _array


@dataclass(eq=False)
class Tensor:
    tiles: DataFrame
    inputs: tuple = ()
    rule: Callable | None = None
    name: str = ""


@dataclass
class Tape:
    """`window` rows and `head` columns make a tile."""

    spark: SparkSession
    window: int
    head: int
    done: list = field(default_factory=list)

    def _kept(self, x: DataFrame) -> DataFrame:
        path = shared.folder(self.spark, "tape")
        x.write.parquet(path)
        return self.spark.read.schema(tiles.TILE).parquet(path)

    def _new(self, x: DataFrame, inputs: tuple, rule: Callable) -> Tensor:
        self.done.append(Tensor(self._kept(x), inputs, rule))
        return self.done[-1]

    def leaf(self, x: DataFrame, name: str = "") -> Tensor:
        """A parameter or an input."""
        return Tensor(self._kept(x), name=name)

    def product(self, x: Tensor, w: Tensor) -> Tensor:
        """x W^T."""

        def rule(g: DataFrame) -> tuple:
            return tiles.product_nn(g, w.tiles), tiles.product_tn(g, x.tiles)

        return self._new(tiles.product_nt(x.tiles, w.tiles), (x, w), rule)

    def add(self, x: Tensor, y: Tensor) -> Tensor:
        return self._new(tiles.zip_tiles(x.tiles, y.tiles, np.add), (x, y), lambda g: (g, g))

    def norm(self, x: Tensor, width: int, eps: float = 1e-5) -> Tensor:
        """x / sqrt(mean x^2 + eps) over rows of `width` values, in however many column tiles."""
        square = self._kept(tiles.add_up(x.tiles, lambda r: [(r["i"], 0, (_array(r) ** 2).sum(1, keepdims=True))]))
        root = lambda s: 1 / np.sqrt(s / width + eps)

        def rule(g: DataFrame) -> tuple:
            both = tiles.beside(g, x.tiles)
            dots = tiles.add_up(both, lambda r: [(r["i"], 0, (_array(r) * _array(r, "r_")).sum(1, keepdims=True))])
            sums = square.select("i", *(F.col(c).alias(f"s_{c}") for c in ("h", "w", "data"))).join(dots.select("i", *(F.col(c).alias(f"d_{c}") for c in ("h", "w", "data"))), "i")

            def back(r: dict) -> list:
                q = root(_array(r, "s_"))
                return [(r["i"], r["j"], q * _array(r) - _array(r, "r_") * q**3 * _array(r, "d_") / width)]

            return (tiles.each(both.join(sums, "i"), back),)

        return self._new(tiles.with_rows(x.tiles, square, lambda v, s: v * root(s)), (x,), rule)

    def rotate(self, x: Tensor, theta: float = 10000.0) -> Tensor:
        """Rotary embedding of each head in half-split layout; a row's position is its number."""
        window, half = self.window, self.head // 2

        def turned(r: dict, way: float) -> list:
            v = _array(r)
            at = (r["i"] * window + np.arange(len(v)))[:, None] * theta ** -(np.arange(half) * 2 / (2 * half))[None, :]
            c, s, (a, b) = np.cos(at), way * np.sin(at), np.hsplit(v, 2)
            return [(r["i"], r["j"], np.hstack([a * c - b * s, b * c + a * s]))]

        return self._new(tiles.each(x.tiles, lambda r: turned(r, 1.0)), (x,), lambda g: (tiles.each(g, lambda r: turned(r, -1.0)),))

    def attention(self, q: Tensor, k: Tensor, v: Tensor, group: int = 1) -> Tensor:
        """Causal softmax(q k^T / sqrt(head)) v of each window and head; `group` query heads share a key-value head."""
        scale = self.head**-0.5
        kv = k.tiles.select("i", F.col("j").alias("kv"), F.col("h").alias("k_h"), F.col("w").alias("k_w"), F.col("data").alias("k_data")).join(v.tiles.select("i", F.col("j").alias("kv"), F.col("h").alias("v_h"), F.col("w").alias("v_w"), F.col("data").alias("v_data")), ["i", "kv"])
        heads = q.tiles.withColumn("kv", F.floor(F.col("j") / group).cast("long"))
        rows = heads.join(kv, ["i", "kv"])

        def shares(r: dict) -> np.ndarray:
            s = _array(r) @ _array(r, "k_").T * scale
            s[np.triu_indices(len(s), 1)] = -np.inf
            e = np.exp(s - s.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        def rule(g: DataFrame) -> tuple:
            both = rows.join(g.select("i", "j", F.col("h").alias("g_h"), F.col("w").alias("g_w"), F.col("data").alias("g_data")), ["i", "j"])

            def scores(r: dict) -> tuple:
                p = shares(r)
                dp = _array(r, "g_") @ _array(r, "v_").T
                return p, p * (dp - (p * dp).sum(1, keepdims=True)) * scale

            dq = tiles.each(both, lambda r: [(r["i"], r["j"], scores(r)[1] @ _array(r, "k_"))])
            dk = tiles.each(both, lambda r: [(r["i"], r["kv"], scores(r)[1].T @ _array(r))])
            dv = tiles.each(both, lambda r: [(r["i"], r["kv"], scores(r)[0].T @ _array(r, "g_"))])
            return (dq, *(x if group == 1 else tiles.add_up(x) for x in (dk, dv)))

        return self._new(tiles.each(rows, lambda r: [(r["i"], r["j"], shares(r) @ _array(r, "v_"))]), (q, k, v), rule)

    def swiglu(self, u: Tensor, t: Tensor) -> Tensor:
        """silu(u) t."""
        gate = lambda x: 1 / (1 + np.exp(-x))

        def rule(g: DataFrame) -> tuple:
            both = self._kept(tiles.zip_tiles(u.tiles, t.tiles, lambda a, b: np.hstack([a, b])))

            def du(dy: np.ndarray, x: np.ndarray) -> np.ndarray:
                a, b = np.hsplit(x, 2)
                return dy * b * gate(a) * (1 + a * (1 - gate(a)))

            return tiles.zip_tiles(g, both, du), tiles.zip_tiles(g, u.tiles, lambda dy, a: dy * a * gate(a))

        return self._new(tiles.zip_tiles(u.tiles, t.tiles, lambda a, b: a * gate(a) * b), (u, t), rule)

    def cross_entropy(self, logits: Tensor, target: DataFrame, rows: int, width: int) -> Tensor:
        """Mean of -log softmax at each row's target (tiles (i, 0) of one column); `width` columns make a tile. A row's
        maximum and scaled sum are merged over its column tiles."""

        def state(r: dict) -> list:
            x = _array(r)
            top = x.max(1, keepdims=True)
            return [(r["i"], 0, np.hstack([top, np.exp(x - top).sum(1, keepdims=True)]))]

        both = self._kept(tiles.zip_tiles(tiles.merge(logits.tiles, softmax_state, state), target, lambda s, y: np.hstack([s, y])))

        def hit(r: dict) -> tuple:
            x, (top, total, y) = _array(r), np.hsplit(_array(r, "r_"), 3)
            return x, top, total, y == r["j"] * width + np.arange(x.shape[1])

        def part(r: dict) -> list:
            x, top, total, own = hit(r)
            return [(0, 0, np.where(own, np.log(total) + top - x, 0.0).sum(keepdims=True) / rows)]

        def back(r: dict) -> list:
            x, top, total, own = hit(r)
            return [(r["i"], r["j"], (np.exp(x - top) / total - own) / rows)]

        beside = tiles.beside(logits.tiles, both.drop("j"), ["i"])
        return self._new(tiles.add_up(beside, part), (logits,), lambda g: (tiles.each(beside, back),))

    def gradients(self, loss: Tensor, *wanted: Tensor) -> list[DataFrame]:
        """The gradient of a loss (its own seed is 1) by each of `wanted`."""
        sent: dict[Tensor, list[DataFrame]] = {loss: [loss.tiles]}
        for node in reversed(self.done):
            if node not in sent:
                continue
            parts = sent.pop(node)
            g = parts[0]
            for more in parts[1:]:
                g = g.unionByName(more)
            g = self._kept(g if len(parts) == 1 else tiles.add_up(g))
            for x, own in zip(node.inputs, node.rule(g), strict=True):
                sent.setdefault(x, []).append(own)
        out = []
        for x in wanted:
            g = sent[x][0]
            for more in sent[x][1:]:
                g = g.unionByName(more)
            out.append(g if len(sent[x]) == 1 else tiles.add_up(g))
        return out


def softmax_state(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges rows of (maximum, sum scaled by it, sums of values scaled by it...), in any order."""
    top = np.maximum(a[:, :1], b[:, :1])
    return np.hstack([top, a[:, 1:] * np.exp(a[:, :1] - top) + b[:, 1:] * np.exp(b[:, :1] - top)])
