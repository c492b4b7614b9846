"""Aggregates, windows, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contracts, digests, optimizer, running, tensors
from ..session import table
from ._register import LONG, query


@query("a01_element_sum", "select sum(len(embedding))::bigint elements from embeddings")
def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.sum(F.size("embedding")).alias("elements"))


@query("a02_array_product", "select l_orderkey, product(l_linenumber)::bigint numel from lineitem group by l_orderkey")
def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.product("l_linenumber").cast("long").alias("numel"))


@query("a03_max_abs_error", f"select r, round(max(abs(round(x, 2) - x)), 6) max_abs from {LONG} group by r")
def max_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return x.groupBy("r").agg(F.round(F.max(F.abs(F.round("x", 2) - F.col("x"))), 6).alias("max_abs"))


@query("a04_max_rel_error", f"select r, round(max(abs(round(x, 2) - x) / greatest(1e-12::double, abs(round(x, 2)), abs(x))), 6) max_rel from {LONG} group by r")
def max_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.parity import rel_error

    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return x.groupBy("r").agg(F.round(F.max(rel_error(F.round("x", 2), F.col("x"))), 6).alias("max_rel"))


@query("a05_tensor_norms", f"select r, round(sqrt(sum(x * x)), 6) l2, round(max(abs(x)), 6) max_abs from {LONG} group by r")
def tensor_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return optimizer.norms(x, "r", "x").select("r", F.round("l2", 6).alias("l2"), F.round("max_abs", 6).alias("max_abs"))


@query("a06_a07_norm_and_clip", f"select round(sqrt(sum(x * x)), 6) norm, round(least(1::double, 1 / (sqrt(sum(x * x)) + 1e-6)), 9) clip from {LONG}")
def norm_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return optimizer.global_norm(x, "x").select(F.round("norm", 6).alias("norm"), F.round("clip", 9).alias("clip"))


@query("a08_uniqueness_gate", "select event_type, count(distinct user_id) = 1 single from events group by event_type")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.countDistinct("user_id") == 1).alias("single"))


@query("a09_duplicates", "select user_id, event_type, count(*) n from events group by all having count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicates(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("a10_sorted_distinct", "select l_returnflag, list_sort(list_distinct(list(l_discount))) discounts from lineitem group by l_returnflag")
def sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sort_array(F.collect_set("l_discount")).alias("discounts"))


@query("a11_collect_per_group", "select n_regionkey, list(n_name order by n_name) names from nation group by n_regionkey")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))


@query("a12_backend_counts", "select count(*) filter (where event_type = 'view') view_ops, count(*) filter (where event_type = 'click') click_ops, count(*) filter (where event_type not in ('view', 'click')) other_ops from (select distinct user_id, event_type from events)")
def backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each callback (user) counts once for each backend (type)."""
    d = table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()
    return d.agg(F.count_if(F.col("event_type") == "view").alias("view_ops"), F.count_if(F.col("event_type") == "click").alias("click_ops"), F.count_if(~F.col("event_type").isin("view", "click")).alias("other_ops"))


@query("d15_backend_counts_by_hour", "select hour(ts)::int h, event_type, count(*) n from events group by all")
def by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("h"), "event_type").agg(F.count("*").alias("n"))


@query("a13_token_bounds", "select min((props->>'$.k')::int) lo, max((props->>'$.k')::int) hi from events")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").agg(F.min(k).alias("lo"), F.max(k).alias("hi"))


@query("a14_byte_total", "select source, sum(strlen(text))::bigint bytes from documents group by source")
def bytes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("a15_mean_square", f"select r, round(avg(x * x), 9) ms from {LONG} group by r")
def mean_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").groupBy("r").agg(F.round(F.avg(F.col("x") * F.col("x")), 9).alias("ms"))


@query("a16_logsumexp", f"with v as {LONG}, m as (select r, max(x) m from v group by r) select v.r, round(any_value(m) + ln(sum(exp(x - m))), 6) lse from v join m using (r) group by v.r")
def logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted by the row's maximum, which rides along as a window value."""
    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    m = x.withColumn("m", F.max("x").over(Window.partitionBy("r")))
    return m.groupBy("r").agg(F.round(F.first("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m")))), 6).alias("lse"))


@query("a17_digest", "select doc_id, sha256(text) sha from documents")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("a18_ordered_state_digest", "select n_regionkey, sha256(string_agg(n_nationkey || ':' || n_name, ';' order by n_nationkey)) sha from nation group by all")
def state_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a group's entries in key order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.concat_ws(":", s["n_nationkey"].cast("string"), s["n_name"]))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(parts, ";"), 256).alias("sha"))


@query("a21_all", "select o_custkey, bool_and(o_orderstatus in ('O', 'F')) ok from orders group by o_custkey")
def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus").isin("O", "F")).alias("ok"))


@query("w04_f16_next_token", "select event_id, user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) next_type from events")
def next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lead("event_type").over(w).alias("next_type"))


@query("w05_causal_frame", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 6) running from events")
def causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are blocks, so a hot user's history is a window for each day and an offset for each day before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return running.running_sum(e, "user_id", ["ts", "event_id"], "value", F.to_date("ts")).select("event_id", F.round("running", 6).alias("running"))


@query("w06_packed_windows", "select event_id // 256 window_id, count(*) tokens, min(user_id) lo, max(user_id) hi from events group by all having count(*) = 256")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full windows of 256 tokens; positions are the dense ids, so no global sort is needed."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.floor(F.col("event_id") / 256).alias("window_id")).agg(F.count("*").alias("tokens"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi")).filter("tokens = 256")


@query("w08_priority_pick", "select user_id, arg_min(event_id, (case event_type when 'purchase' then 0 when 'click' then 1 else 2 end) * 1000000000 + event_id) picked from events group by user_id")
def pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(rank, "event_id")).alias("picked"))


@query("o01_o05_sorted_keys", "select n_regionkey, string_agg(n_name, ',' order by n_name) names from nation group by all")
def sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("o02_probe_indices", "select vec_id, list_sort(list_distinct(list_transform(range(1, 17), lambda i: (vec_id * i) % 64)))::bigint[] probes from embeddings")
def probe_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.col("vec_id") * i) % 64))).alias("probes"))


@query("o03_last_inspected", "with g as (select l_suppkey, list(l_orderkey order by l_orderkey, l_linenumber) a from lineitem group by all) select l_suppkey, a[greatest(len(a) - 11, 1):] last12 from g")
def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve by rank: each task keeps twelve of a supplier before the shuffle, so a hot one is
    no long list."""
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber")))
    top = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").withColumn("place", rank).filter("place <= 12")
    own = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("p"), "l_orderkey"))), lambda s: s["l_orderkey"])
    return top.groupBy("l_suppkey").agg(own.alias("last12"))


@query("o04_sorted_groups", "select user_id, count(*) n, row_number() over (order by count(*) desc, user_id)::int place from events group by user_id order by place limit 20")
def sorted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest groups; only they are ranked."""
    top = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")))


@query("o06_unconsumed_message", "select p_brand, 'unconsumed: ' || string_agg(p_name, ', ' order by p_name) message from part where p_size > 40 group by p_brand")
def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of all names for each brand. Names are sorted by ranges and tasks join them into pieces, so what meets for
    a brand is a piece from each task."""
    part = table(spark, sf_dir, "part").filter("p_size > 40")
    pieces = digests.chunks(part, ["p_brand"], ["p_name"], F.col("p_name"), b", ").select("p_brand", F.struct("part", "seq", F.col("data").cast("string").alias("names")).alias("piece"))
    unnamed = part.filter("p_name is null").select("p_brand", F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece")).distinct()
    g = pieces.unionByName(unnamed).groupBy("p_brand").agg(F.array_sort(F.collect_list("piece")).alias("l"))
    return g.select("p_brand", F.when(F.size("l") > 0, F.concat(F.lit("unconsumed: "), F.array_join(F.transform("l", lambda p: p["names"]), ", "))).alias("message"))
