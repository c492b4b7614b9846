"""The gradient of a whole decoder block by all its matrices, on a tape over tiles, and products of tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tape, tiles, training
from ..session import table
from ._register import LONG, query
from .join_queries import _W
from .model_queries import _BLOCK, _HIDDEN, _MAT, _NORM, _product, CONTEXT

WIDTH, CLASSES = 64, 10
#: Slots with their number in the rule, rows and columns.
SLOTS = {"q": (0, WIDTH, WIDTH), "k": (1, WIDTH, WIDTH), "v": (2, WIDTH, WIDTH), "o": (3, WIDTH, WIDTH), "gate": (4, _HIDDEN, WIDTH), "up": (5, _HIDDEN, WIDTH), "down": (6, WIDTH, _HIDDEN), "head": (7, CLASSES, WIDTH)}


def _through(g: str, k: int, cols: int) -> str:
    """g W of matrix k."""
    return f"(select r, t.c, sum(x * {_MAT.format(k=k).replace('o *', 'g.c *').replace('+ c', '+ t.c')}) x from {g} g cross join range({cols}) t(c) group by r, t.c)"


def _by(slot: str, g: str, a: str) -> str:
    """g^T a: the gradient by a matrix."""
    return f"select '{slot}' slot, g.c o, a.c, round(sum(g.x * a.x), 8) + 0::double g from {g} g join {a} a using (r) group by g.c, a.c"


def _norm_back(g: str, x: str) -> str:
    return f"(select r, c, q * g - x * q * q * q * s x from (select g.r, g.c, g.x g, a.x x, 1 / sqrt(avg(a.x * a.x) over (partition by g.r) + 1e-5) q, avg(g.x * a.x) over (partition by g.r) s from {g} g join {x} a using (r, c)))"


_UNTURN = "(select r, c, x * cos(r * pow(10000::double, -((c % 32) * 2 / 64::double))) + t * sin(r * pow(10000::double, -((c % 32) * 2 / 64::double))) x from (select a.r, a.c, a.x, case when a.c < 32 then b.x else -b.x end t from {g} a join {g} b on a.r = b.r and b.c = (a.c + 32) % 64))"
_BACK = f"""{_BLOCK}, yo as (select r, c, y.x + dn.x x from y join dn using (r, c)), lo as {_product("yo", 7, CLASSES)},
pl as (select r, c, exp(x - m) / sum(exp(x - m)) over (partition by r) x from (select *, max(x) over (partition by r) m from lo)),
gl as (select r, c, (x - case when label = c then 1 else 0 end) / (select count(*) from embeddings) x from pl join embeddings on vec_id = r),
gy as {_through("gl", 7, 64)}, gz as {_through("gy", 6, _HIDDEN)},
gu as (select r, c, gz.x * t.x / (1 + exp(-u.x)) * (1 + u.x * (1 - 1 / (1 + exp(-u.x)))) x from gz join u using (r, c) join t using (r, c)), gt as (select r, c, gz.x * u.x / (1 + exp(-u.x)) x from gz join u using (r, c)),
gf as (select r, c, a.x + b.x x from {_through("gu", 4, 64)} a join {_through("gt", 5, 64)} b using (r, c)),
g2 as (select r, c, gy.x + b.x x from gy join {_norm_back("gf", "y")} b using (r, c)), ga as {_through("g2", 3, 64)},
gp as (select i, j, p, sum(ga.x * vv.x) d from p join ga on ga.r = i join vv on vv.r = j and vv.c = ga.c group by all),
gs as (select i, j, p * (d - sum(p * d) over (partition by i)) / 8 x from gp),
gv as (select j r, c, sum(p * x) x from p join ga on ga.r = i group by j, c), gq as (select i r, c, sum(gs.x * k.x) x from gs join k on k.r = j group by i, c), gk as (select j r, c, sum(gs.x * q.x) x from gs join q on q.r = i group by j, c),
gq0 as {_UNTURN.format(g="gq")}, gk0 as {_UNTURN.format(g="gk")}"""
_PARTS = [("q", "gq0", "h"), ("k", "gk0", "h"), ("v", "gv", "h"), ("o", "g2", "a"), ("gate", "gu", "f"), ("up", "gt", "f"), ("down", "gy", "z"), ("head", "gl", "yo")]


def _rule(k: int):
    return lambda o, c: np.sin(o * 64 + c + 1000 * k) / 8


@query("m09_m12_block_gradient", f"with {_BACK} {' union all '.join(_by(*p) for p in _PARTS)}")
def block_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cross-entropy of the decoder block of `m09_decoder_block` under a linear head, and its gradient by all
    eight matrices: every operator records its rule on a tape that is walked back."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    t = tape.Tape(spark, CONTEXT, WIDTH)
    x = t.leaf(tiles.from_rows(e, "vec_id", "embedding", CONTEXT, WIDTH))
    target = t.leaf(tiles.from_rows(e.select("vec_id", F.array("label").alias("label")), "vec_id", "label", CONTEXT, 1)).tiles
    w = {s: t.leaf(tiles.from_rule(e, rows, cols, 64, 64, _rule(k)), s) for s, (k, rows, cols) in SLOTS.items()}
    h = t.norm(x, WIDTH)
    q, k, v = t.rotate(t.product(h, w["q"])), t.rotate(t.product(h, w["k"])), t.product(h, w["v"])
    y = t.add(x, t.product(t.attention(q, k, v), w["o"]))
    f = t.norm(y, WIDTH)
    out = t.add(y, t.product(t.swiglu(t.product(f, w["gate"]), t.product(f, w["up"])), w["down"]))
    loss = t.cross_entropy(t.product(out, w["head"]), target, n, 64)
    parts = [tiles.to_long(g, 64, 64).select(F.lit(s).alias("slot"), F.col("r").alias("o"), "c", (F.round("x", 8) + 0.0).alias("g")) for s, g in zip(w, t.gradients(loss, *w.values()), strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


@query("j11_matmul_tiles", f"select r, w.o::bigint c, round(sum(x * w), 6) x from {LONG} v join {_W} w using (c) group by r, w.o")
def matmul_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against each label's weights as a product of tiles, 128 rows and 16 columns of vectors each."""
    from .join_queries import class_weights

    e = table(spark, sf_dir, "embeddings")
    rows = class_weights(spark, sf_dir).groupBy(F.col("o").cast("long").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda s: s["w"]).alias("w"))  # one row of 64
    names = rows.select("o").withColumn("n", F.row_number().over(Window.orderBy("o")).cast("long") - 1)  # a row for each label
    w = tiles.from_rows(rows.join(names, "o"), "n", "w", 8, 16)
    y = tiles.to_long(tiles.product_nt(tiles.from_rows(e, "vec_id", "embedding", 128, 16), w), 128, 8)
    return y.join(names, F.col("c") == F.col("n")).select("r", F.col("o").alias("c"), F.round("x", 6).alias("x"))


_LR, _B1, _B2 = "1e-2::double", "0.9::double", "0.95::double"


def _step(n: int) -> str:
    """State w{n}, m{n}, v{n} after step n of the head, from that before."""
    return f"""l{n} as (select r, o, sum(x * w) x from {LONG} t join w{n - 1} using (c) group by r, o), p{n} as (select r, o, exp(x - m) / sum(exp(x - m)) over (partition by r) p from (select *, max(x) over (partition by r) m from l{n})),
g{n} as (select o, c, sum((p - case when o = label then 1 else 0 end) * t.x) / (select count(*) from embeddings) g from p{n} join embeddings on vec_id = p{n}.r join {LONG} t on t.r = p{n}.r group by o, c),
k{n} as (select least(1::double, 0.05::double / (sqrt(sum(g * g)) + 1e-6::double)) k from g{n}),
s{n} as (select o, c, w, {_B1} * m + (1 - {_B1}) * g * k m, {_B2} * v + (1 - {_B2}) * g * k * g * k v from w{n - 1} join g{n} using (o, c) cross join k{n}),
w{n} as (select o, c, w - {_LR} * 0.1::double * w - {_LR} * (m / (1 - pow({_B1}, {n}))) / (sqrt(v / (1 - pow({_B2}, {n}))) + 1e-8::double) w, m, v from s{n})"""


@query("m10_m15_head_training", f"with w0 as (select o, c, {_MAT.format(k=7)} w, 0::double m, 0::double v from range({CLASSES}) a(o), range(64) b(c)), {', '.join(_step(n) for n in (1, 2, 3))} select o, c, round(w, 8) + 0::double w, round(m, 8) + 0::double m, round(1000 * v, 8) + 0::double v from w3")
def head_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of a linear head on the tape, clipped by the gradient's norm, with decay; its values and moments are
    tiles from step to step."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    x = tiles.from_rows(e, "vec_id", "embedding", 128, 64)
    target = tiles.from_rows(e.select("vec_id", F.array("label").alias("label")), "vec_id", "label", 128, 1)

    def loss(t: tape.Tape, p: dict) -> tape.Tensor:
        return t.cross_entropy(t.product(t.leaf(x), p["head"]), target, n, 64)

    start = {"head": tiles.from_rule(e, CLASSES, WIDTH, 64, 64, _rule(7))}
    states, _ = training.train(spark, start, loss, 3, 128, WIDTH, lr=1e-2, decay=0.1, most=0.05)
    rows = tiles.to_long(states["head"], 64, 3 * WIDTH).withColumn("part", F.floor(F.col("c") / WIDTH))
    pick = lambda k, f=1: F.round(F.max(F.when(F.col("part") == k, F.col("x"))) * f, 8) + 0.0
    return rows.groupBy(F.col("r").alias("o"), (F.col("c") % WIDTH).alias("at")).agg(pick(0).alias("w"), pick(1).alias("m"), pick(2, 1000).alias("v")).withColumnRenamed("at", "c")
