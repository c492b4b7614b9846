"""Scalar, array, binary and JSON functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling
from ..operators import tensors
from ..session import table
from ._register import LONG, query


@query("x01_lower_contains", "select p_partkey, lower(p_name) low, contains(lower(p_name), 'a') has from part")
def lower_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("low"), F.lower("p_name").contains("a").alias("has"))


@query("x02_regex_search", "select doc_id, regexp_matches(text, '[0-9]{4,}') hit from documents")
def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[0-9]{4,}").alias("hit"))


@query("x03_regex_extract", "select page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) host from pages")
def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?)://([^/]+)", 2).alias("host"))


@query("x04_replace_format", "select c_custkey, replace(c_name, '#', '/') || ':' || c_nationkey label from customer")
def replace_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%s:%d", F.replace("c_name", F.lit("#"), F.lit("/")), "c_nationkey").alias("label"))


@query("x05_thread_label", "select event_id, 'worker-' || lower(event_type) label from events")
def thread_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("worker-"), F.lower("event_type")).alias("label"))


@query("x06_case_insensitive_hash", "select doc_id, lower(upper(sha256(text))) = sha256(text) same from documents")
def hash_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", (F.lower(F.upper(sha)) == F.lower(sha)).alias("same"))


@query("x07_hex_encoding", "select n_nationkey, lower(hex(encode(n_name))) h from nation")
def hex_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.hex("n_name")).alias("h"))


@query("x08_square_roots", "select l_orderkey, l_linenumber, l_quantity * l_quantity sq, round(sqrt(l_quantity), 9) root, round(1 / sqrt(l_quantity), 9) inverse from lineitem")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * q).alias("sq"), F.round(F.sqrt(q), 9).alias("root"), F.round(1 / F.sqrt(q), 9).alias("inverse"))


@query("x09_transcendental", "select l_orderkey, l_linenumber, round(exp(l_discount), 9) e, round(ln(l_quantity), 9) l, round(pow(1 + l_tax, 3), 9) p, round(cos(l_discount), 9) c, round(sin(l_discount), 9) s from lineitem")
def transcendental(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    cols = {"e": F.exp(d), "l": F.log("l_quantity"), "p": F.pow(1 + F.col("l_tax"), F.lit(3)), "c": F.cos(d), "s": F.sin(d)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(v, 9).alias(k) for k, v in cols.items()))


@query("x10_abs_min_max", "select c_custkey, abs(c_acctbal) a, least(c_acctbal, 100) lo, greatest(c_acctbal, 100) hi from customer")
def abs_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.abs(b).alias("a"), F.least(b, F.lit(100.0)).alias("lo"), F.greatest(b, F.lit(100.0)).alias("hi"))


@query("x11_silu", f"select r, c, round(x / (1 + exp(-x)), 9) y from {LONG}")
def silu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("r", "c", F.round(tensors.silu(F.col("x")), 9).alias("y"))


@query("x12_negate", "select event_id, -value negated from events")
def negate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (-F.col("value")).alias("negated"))


@query("x13_split_halves", "select vec_id, list_concat(list_transform(embedding[33:], lambda x: -x), embedding[:32]) turned from embeddings")
def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.transform(F.slice("embedding", 33, 32), lambda x: -x), F.slice("embedding", 1, 32)).alias("turned"))


@query("x14_pair_swap", "select vec_id, list_transform(range(0, 64), lambda i: case when i % 2 = 0 then -embedding[i + 2] else embedding[i] end) turned from embeddings")
def pair_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    turned = F.transform(e, lambda x, i: F.when(i % 2 == 0, -F.element_at(e, F.least(i + 2, F.size(e)))).otherwise(F.element_at(e, F.greatest(i, F.lit(1)))))
    return table(spark, sf_dir, "embeddings").select("vec_id", turned.alias("turned"))


@query("x15_transpose", f"select c r, r c, round(x, 6) x from {LONG}")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.transpose(tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")).select("r", "c", F.round("x", 6).alias("x"))


@query("x16_reshape", f"select (r * 64 + c) // 16 r, (r * 64 + c) % 16 c, round(x, 6) x from {LONG}")
def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.reshape(tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 64, 16).select("r", "c", F.round("x", 6).alias("x"))


@query("f22_flatten", f"select r * 64 + c idx, round(x, 6) x from {LONG}")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select((F.col("r") * 64 + F.col("c")).alias("idx"), F.round("x", 6).alias("x"))


@query("f21_cast_float", "select l_orderkey, l_linenumber, l_extendedprice::float::double x from lineitem")
def cast_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("float").cast("double").alias("x"))


@query("x17_tile", "select n_nationkey, t::int copy from nation, range(3) x(t)")
def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))


@query("x18_one_hot", "select vec_id, list_transform(range(0, 10), lambda i: case when i = label then 1 else 0 end)::int[] hot from embeddings")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1).otherwise(0)).alias("hot"))


@query("x19_gather_axis", "select vec_id, embedding[label + 1] picked from embeddings")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at("embedding", F.col("label") + 1).alias("picked"))


@query("x20_broadcast_arithmetic", "select l_orderkey, l_linenumber, round(l_extendedprice - m, 4) centred from lineitem join (select l_returnflag, avg(l_extendedprice) m from lineitem group by all) using (l_returnflag)")
def broadcast_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    mean = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m"))
    return li.join(mean, "l_returnflag").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - F.col("m"), 4).alias("centred"))


@query("x21_constant_tables", "select p, i, round(cos(p * pow(10000::double, -2.0::double * i / 64)), 9) c, round(sin(p * pow(10000::double, -2.0::double * i / 64)), 9) s from (select vec_id p from embeddings), range(32) t(i)")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation tables of 32 frequencies for every position of the embeddings."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("i"))
    angle = F.col("p").cast("double") * F.pow(F.lit(10000.0), -2.0 * F.col("i") / 64)
    return t.select("p", "i", F.round(F.cos(angle), 9).alias("c"), F.round(F.sin(angle), 9).alias("s"))


@query("x23_seeded_sampling", "select n_name, list_sort(list_distinct(list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(n_name || ':' || i), 1, 15))::bigint % 384))) probes from nation")
def sampling_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", sampling.probe_indices(F.col("n_name"), 16, 384).alias("probes"))


@query("x23_numpy_probes")
def numpy_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen draws for each part's name, equal to those of NumPy's generator; their upper bound is the part's number
    times its size, so both ways of drawing are used. (No SQL: tests compare every name with NumPy.)"""
    p = table(spark, sf_dir, "part").withColumn("size", (F.col("p_partkey") + 1) * F.col("p_size") * F.when(F.col("p_partkey") % 2 == 0, F.lit(1 << 33)).otherwise(F.lit(1)))
    return sampling.numpy_probes(p, "p_partkey", "p_name", "size").withColumnRenamed("key", "p_partkey")


@query("x24_byte_equality", "select b.item_id, count(d.doc_id) copies from benchmark b left join documents d on sha256(b.text) = sha256(d.text) group by b.item_id")
def byte_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return b.join(d, "sha", "left").groupBy("item_id").agg(F.count("doc_id").alias("copies"))


@query("x25_elapsed", "select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from events group by user_id")
def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)).alias("seconds"))


@query("f27_json_escape", "select doc_id, to_json(text)::varchar j from documents")
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.to_json(F.struct(F.col("text").alias("t")))
    return table(spark, sf_dir, "documents").withColumn("j", j).selectExpr("doc_id", "substring(j, 6, length(j) - 6) as j")


@query("x26_json_field", "select event_id, props->>'$.k' k from events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("s16_canonical_json", """select s_suppkey, '{"key":' || s_suppkey || ',"name":"' || s_name || '","nation":' || s_nationkey || '}' doc from supplier""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"nation": F.col("s_nationkey"), "key": F.col("s_suppkey"), "name": F.col("s_name")}
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).alias("doc"))


@query("d07_probe_unpivot", "select l_orderkey, l_linenumber, name, value from lineitem unpivot (value for name in (l_quantity, l_discount, l_tax))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")
