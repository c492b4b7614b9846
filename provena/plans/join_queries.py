"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sampling
from ..operators import contracts, tensors
from ..session import table
from ._register import LONG, query


@query("j01_key_set_equality", "select coalesce(c.k, o.k) as key, case when c.k is null then 'right' else 'left' end only_in from (select distinct c_custkey k from customer) c full join (select distinct o_custkey k from orders where o_orderstatus = 'F') o on c.k = o.k where c.k is null or o.k is null")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return contracts.key_difference(c, o, "key")


@query("j02_mapping_join", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")


@query("j03_required_lookup", "select s_suppkey, n_name, n_name is not null found from supplier left join nation on s_nationkey = n_nationkey")
def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", "n_name", F.col("n_name").isNotNull().alias("found"))


@query("j04_slot_decay", "select l_orderkey, l_linenumber, round(l_quantity * p_size / 100, 6) decayed from lineitem join part on l_partkey = p_partkey")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("p_size") / 100, 6).alias("decayed"))


@query("j08_logit_probe", f"with v as {LONG} select vec_id r, label::bigint c, round(x, 6) x from embeddings join v on r = vec_id and c = label")
def logit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = tensors.to_long(e, "vec_id", "embedding")
    keys = e.select(F.col("vec_id").alias("r"), F.col("label").cast("long").alias("c"))
    return v.join(keys, ["r", "c"]).select("r", "c", F.round("x", 6).alias("x"))


@query("j09_probe_grid", "select r_regionkey, k::int token from region, range(7) t(k)")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by classes, made by a generator of fixed size in each row."""
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("token"))


@query("j10_embedding_gather", "select event_id, user_id % (select count(*) from embeddings) as token, round(embedding[1]::double, 6) first_value from events join embeddings on vec_id = user_id % (select count(*) from embeddings)")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's row of the embedding table, whose size bounds the tokens."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.element_at("embedding", 1).cast("double").alias("x"))
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % F.lit(emb.count())).alias("token"))
    return ev.join(emb, "token").select("event_id", "token", F.round("x", 6).alias("first_value"))


#: Values of a weight that may be broadcast.
HELD_WEIGHTS = 1 << 20
_W = f"(select label o, c, avg(x) w from {LONG} join embeddings on vec_id = r group by all)"


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weight row for each label: its mean vector, (o, c, w)."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("label").alias("o"), F.posexplode("embedding")).select("o", F.col("pos").cast("long").alias("c"), F.col("col").cast("double").alias("x"))
    return v.groupBy("o", "c").agg(F.avg("x").alias("w"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, x): each vector against each label's weight."""
    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return tensors.matmul(x, class_weights(spark, sf_dir)).select("r", F.col("o").cast("long").alias("c"), F.col("y").alias("x"))


@query("j11_matmul_relational", f"select r, w.o::bigint c, round(sum(x * w), 6) x from {LONG} v join {_W} w using (c) group by r, w.o")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("r", "c", F.round("x", 6).alias("x"))


@query("m03_linear_arrow", f"select r, w.o::bigint c, round(sum(x * w), 6) x from {LONG} v join {_W} w using (c) group by r, w.o")
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same product by numpy blocks with the weight broadcast (one row for each label), as long as it has no more
    than `HELD_WEIGHTS` values; beyond, by a join."""
    import numpy as np

    weights = class_weights(spark, sf_dir)
    if weights.count() > HELD_WEIGHTS:
        return matmul(spark, sf_dir)
    rows = weights.orderBy("o", "c").collect()  # labels by width
    names = sorted({r["o"] for r in rows})
    weight = np.array([r["w"] for r in rows]).reshape(len(names), -1)
    out = tensors.linear_arrow(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", weight)
    return out.select("r", F.posexplode("vec")).select("r", F.element_at(F.array(*(F.lit(n).cast("long") for n in names)), F.col("pos") + 1).alias("c"), F.round("col", 6).alias("x"))


@query("j14_kv_head_expansion", "select (r_regionkey * 3 + g)::int head, r_regionkey kv_head, r_name from region, range(3) t(g)")
def kv_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query head h reads key-value head h div 3; each kv head serves three query heads."""
    return table(spark, sf_dir, "region").select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g"), "r_regionkey", "r_name").select((F.col("r_regionkey") * 3 + F.col("g")).cast("int").alias("head"), F.col("r_regionkey").alias("kv_head"), "r_name")


@query("a24_head_weight_sum", "select n_regionkey kv_head, sum(n_nationkey)::bigint total from nation group by all")
def head_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("kv_head")).agg(F.sum("n_nationkey").alias("total"))


@query("j15_anti_join", "select doc_id from documents anti join labels using (doc_id)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j16_hash_linkage", "with c as (select n_chars, lang, sha256(arg_min(text, doc_id)) h from documents semi join labels using (doc_id) group by n_chars, lang) select doc_id, h is null or h = sha256(text) linked from documents d left join c on c.n_chars = d.n_chars and c.lang = d.lang")
def hash_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared hash must equal the computed one, but only where it is declared. The contract declares,
    for a language and length, the hash of the first labelled document; copies of it keep the contract."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("got"))
    known = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    declared = known.groupBy("lang", "n_chars").agg(F.min_by("got", "doc_id").alias("want"))
    return d.join(declared, ["lang", "n_chars"], "left").select("doc_id", (F.col("want").isNull() | (F.lower("want") == F.lower("got"))).alias("linked"))


@query("j17_file_manifest", "select doc_id, n_chars = length(text) size_ok from documents")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries (id, size) against contents by id."""
    d = table(spark, sf_dir, "documents")
    manifest = d.select("doc_id", "n_chars")
    contents = d.select("doc_id", F.length("text").cast("long").alias("length"))
    return manifest.join(contents, "doc_id", "left").select("doc_id", F.coalesce(F.col("n_chars") == F.col("length"), F.lit(False)).alias("size_ok"))


@query("j19_group_parameters", "select p_brand slot, p_partkey // 1000 chunk, list(p_partkey order by p_partkey) params from part group by all")
def group_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's parameters in order, in chunks of a thousand keys at most."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slot"), F.floor(F.col("p_partkey") / 1000).cast("long").alias("chunk"))
    return g.agg(F.sort_array(F.collect_list("p_partkey")).alias("params"))


@query("g01_set_equality", "select (select count(*) from (select distinct c_nationkey from customer except select n_nationkey from nation)) = 0 and (select count(*) from (select n_nationkey from nation except select distinct c_nationkey from customer)) = 0 equal")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))


@query("g02_set_difference", "select doc_id from documents except select doc_id from labels")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("g03_scan_dedupe", "select distinct split_part(url, '/', 3) host from pages")
def scan_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).dropDuplicates(["host"])


@query("g04_map_merge", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    m = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.map_concat(F.create_map(F.lit("n"), "n_name"), F.create_map(F.lit("r"), "r_name")).alias("m"))
    return m.select("n_nationkey", F.col("m")["n"].alias("n_name"), F.col("m")["r"].alias("r_name"))


@query("g05_deduped_draw", "select l_orderkey, list_sort(list_distinct(list(l_suppkey % 7))) draws from lineitem group by l_orderkey")
def draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.collect_list(F.col("l_suppkey") % 7))).alias("draws"))


@query("g05_numpy_draw")
def numpy_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of each nation's suppliers: draws below the nation's number of suppliers, deduped and sorted, and the
    suppliers that they hit. (No SQL: tests compare every nation with NumPy.)"""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("place"))
    n = table(spark, sf_dir, "nation").join(s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers")), "n_nationkey")
    probes = sampling.numpy_probes(n, "n_nationkey", "n_name", "suppliers").select(F.col("key").alias("s_nationkey"), F.explode("probes").alias("probe"))
    return probes.withColumn("place", F.col("probe") + 1).join(s, ["s_nationkey", "place"]).select("s_nationkey", "probe", "s_suppkey")
