"""Training on the tape: parameters and their moments are tables of tiles, and never on the driver.

A parameter's state is one table whose tiles hold the values, first and second moments side by side. A step records the
loss on a new tape, walks it back, scales the gradients by their global norm, and writes new states; what the driver
sees of a step is its loss and norm.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from . import optimizer, tiles
from .tape import Tape, Tensor
from .tiles import _array


def fresh(values: DataFrame) -> DataFrame:
    """The state of a parameter before its first step."""
    return tiles.map_tiles(values, lambda w: np.hstack([w, np.zeros_like(w), np.zeros_like(w)]))


def values(state: DataFrame) -> DataFrame:
    return tiles.map_tiles(state, lambda s: np.hsplit(s, 3)[0])


def squares(gradients: list[DataFrame]) -> float:
    """The sum of all squared values: one number."""
    all_ = gradients[0]
    for g in gradients[1:]:
        all_ = all_.unionByName(g)
    one = tiles.add_up(all_, lambda r: [(0, 0, (_array(r) ** 2).sum().reshape(1, 1))]).first()
    return float(_array(one.asDict())[0, 0]) if one else 0.0


def stepped(state: DataFrame, gradient: DataFrame, n: int, clip: float, lr: float, decay: float, beta1: float, beta2: float, eps: float) -> DataFrame:
    """The state after step n (from 1) with a gradient times `clip`; tiles without a gradient stay as they are."""

    def update(r: dict) -> list:
        s = _array(r)
        if r["r_data"] is None:
            return [(r["i"], r["j"], s)]
        (w, m, v), g = np.hsplit(s, 3), _array(r, "r_") * clip
        m, v = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
        w = w - lr * decay * w - lr * (m / (1 - beta1**n)) / (np.sqrt(v / (1 - beta2**n)) + eps)
        return [(r["i"], r["j"], np.hstack([w, m, v]))]

    both = state.join(gradient.select("i", "j", F.col("h").alias("r_h"), F.col("w").alias("r_w"), F.col("data").alias("r_data")), ["i", "j"], "left")
    return tiles.each(both, update)


def train(spark: SparkSession, start: dict[str, DataFrame], loss: Callable[[Tape, dict[str, Tensor]], Tensor], steps: int, window: int, head: int, lr: float = optimizer.LR, decay: float | dict[str, float] = optimizer.DECAY, beta1: float = optimizer.BETA1, beta2: float = optimizer.BETA2, eps: float = optimizer.EPS, most: float = 1.0) -> tuple[dict[str, DataFrame], list[tuple[float, float]]]:
    """States of the parameters after the steps, and each step's loss and gradient norm. `loss` records the dataflow on
    a tape; gradients are scaled to a norm of `most` at most; `decay` may differ by parameter."""
    states, seen = {k: fresh(v) for k, v in start.items()}, []
    for n in range(1, steps + 1):
        tape = Tape(spark, window, head)
        parameters = {k: tape.leaf(values(s), k) for k, s in states.items()}
        out = loss(tape, parameters)
        gradients = dict(zip(parameters, (tape._kept(g) for g in tape.gradients(out, *parameters.values())), strict=True))
        norm = squares(list(gradients.values())) ** 0.5
        seen.append((float(_array(out.tiles.first().asDict())[0, 0]), norm))
        clip = min(1.0, most / (norm + 1e-6))
        new = {}
        for k, s in states.items():
            path = shared.folder(spark, f"step-{n}")
            stepped(s, gradients[k], n, clip, lr, decay[k] if isinstance(decay, dict) else decay, beta1, beta2, eps).write.parquet(path)
            new[k] = spark.read.schema(tiles.TILE).parquet(path)
        states = new
    return states, seen
