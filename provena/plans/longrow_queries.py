"""Softmax and attention over rows that hold a large part of all items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import longrows, tensors
from ..session import table
from ._register import LONG, query
from .join_queries import _W

#: A handful of rows of line items, one of which holds half of them.
_ITEMS = "(select l_orderkey, l_linenumber, l_returnflag flag, l_quantity / 5 - l_tax * 100 x from lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), (F.col("l_quantity") / 5 - F.col("l_tax") * 100).alias("x"))


@query("w01_long_row_softmax", f"select l_orderkey, l_linenumber, flag, round(1e6 * exp(x - m) / sum(exp(x - m)) over (partition by flag), 5) p from (select *, max(x) over (partition by flag) m from {_ITEMS})")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longrows.softmax(_items(spark, sf_dir), ["flag"]).select("l_orderkey", "l_linenumber", "flag", F.round(F.col("p") * 1e6, 5).alias("p"))


@query("w02_long_row_log_softmax", f"select l_orderkey, l_linenumber, round(x - m - ln(sum(exp(x - m)) over (partition by flag)), 6) logp from (select *, max(x) over (partition by flag) m from {_ITEMS})")
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longrows.log_softmax(_items(spark, sf_dir), ["flag"]).select("l_orderkey", "l_linenumber", F.round("logp", 6).alias("logp"))


@query("a16_long_row_logsumexp", f"select flag, count(*) n, round(max(m) + ln(sum(exp(x - m))), 6) lse from (select *, max(x) over (partition by flag) m from {_ITEMS}) group by flag")
def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longrows.log_sum_exp(_items(spark, sf_dir), ["flag"]).select("flag", "n", F.round("lse", 6).alias("lse"))


@query("m07_long_row_attention", f"with s as (select w.o q, v.r, sum(v.x * w.w) * 5 x from {LONG} v join {_W} w using (c) group by w.o, v.r), p as (select q, r, exp(x - m) / sum(exp(x - m)) over (partition by q) p from (select *, max(x) over (partition by q) m from s)) select q, v.c, round(sum(p * v.x), 8) + 0::double y from p join {LONG} v using (r) group by all")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean vector attends to all embeddings: ten rows as long as the table. Scores and vectors of a batch
    become one state for each label, and only states are shuffled."""
    from .join_queries import class_weights

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    weights = class_weights(spark, sf_dir).groupBy(F.col("o").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda s: s["w"]).alias("w"))  # one row of 64 for each label
    asked = weights.agg(F.collect_list(F.struct("q", "w")).alias("asked"))  # a row that holds the labels' vectors
    scores = e.join(F.broadcast(asked)).select("vec", F.explode("asked").alias("a")).select(F.col("a.q").alias("q"), "vec", (tensors.dot(F.col("vec"), F.col("a.w")) * 5).alias("x"))
    out = longrows.attention(scores, ["q"], "x", "vec")
    return out.select("q", F.posexplode("y")).select("q", F.col("pos").cast("long").alias("c"), (F.round("col", 8) + 0.0).alias("y"))
