"""Contract rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, optimizer, parity
from ..session import table
from ..sources import bundle
from ._register import LONG, query


@query("f02_strict_alias", "select p_brand field, count(distinct p_type) \"values\", min(p_type) \"value\", count(distinct p_type) = 1 agreed from part group by p_brand")
def strict_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.strict_alias(table(spark, sf_dir, "part").select(F.col("p_brand").alias("field"), F.col("p_type").alias("value")))


@query("f03_lenient_alias", "select event_id, coalesce(try_cast(event_type as bigint), try_cast(props->>'$.k' as bigint), user_id) picked from events")
def lenient_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("m", F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.get_json_object("props", "$.k"), F.lit("c"), F.col("user_id").cast("string")))
    return e.select("event_id", contracts.lenient_alias(F.col("m"), "a", "b", "c").alias("picked"))


@query("f04_truthy_chain", "select page_id, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), nullif(regexp_extract(url, '[?](.*)$', 1), ''), url) picked from pages")
def truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", contracts.truthy(part("#(.*)$"), part("[?](.*)$"), F.col("url")).alias("picked"))


@query("f05_first_dict_wins", "select event_id, case when props like '{%' then props else '{}' end picked from events")
def first_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.when(F.from_json("props", "map<string,string>").isNotNull() & F.col("props").startswith("{"), F.col("props")), F.lit("{}")).alias("picked"))


@query("f06_derived_head_dim", "select vec_id, (len(embedding) // 4)::int head_dim from embeddings")
def head_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(size(embedding) div 4 as int) as head_dim")


@query("f07_frozen_geometry", "select vec_id from embeddings where len(embedding) <> 64")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") != 64).select("vec_id")


@query("f08_range_predicates", "select 'discount' rule, l_orderkey::varchar || ':' || l_linenumber entity, l_discount::varchar detail from lineitem where not (l_discount > 0 and l_discount < 0.1) union all select 'size', p_partkey::varchar, p_size::varchar from part where not p_size < 50")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    a = contracts.violations(li, "discount", F.concat_ws(":", "l_orderkey", "l_linenumber"), ~((F.col("l_discount") > 0) & (F.col("l_discount") < 0.1)), F.col("l_discount"))
    b = contracts.violations(p, "size", F.col("p_partkey"), ~(F.col("p_size") < 50), F.col("p_size"))
    return contracts.union(a, b)


@query("f09_in_list", "select o_orderkey, o_orderstatus in ('O', 'F') or o_orderstatus is null known from orders")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus").isin("O", "F") | F.col("o_orderstatus").isNull()).alias("known"))


@query("f10_finiteness", f"select r, count(*) filter (where isfinite(x)) finite_values, count(*) filter (where not isfinite(ln(abs(x) - 0.01))) bad_logs from {LONG} where abs(x) > 0.01 group by r")
def finiteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import tensors

    x = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").filter(F.abs("x") > 0.01)
    return x.groupBy("r").agg(F.count_if(parity.finite(F.col("x"))).alias("finite_values"), F.count_if(~parity.finite(F.log(F.abs("x") - 0.01))).alias("bad_logs"))


@query("f11_vocabulary_bounds", "select event_id, (props->>'$.k')::int token from events where not (props->>'$.k')::int between 0 and 89")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("token")).filter(~F.col("token").between(0, 89))


@query("f12_shape_size", "select l_returnflag, l_linestatus, count(*) rows_, (count(*) * 4 * 3)::bigint nbytes from lineitem group by all")
def shape_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as tensors of shape [rows, 3]; their size follows from the shape."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows_"))
    return g.withColumn("nbytes", contracts.tensor_size(F.array(F.col("rows_"), F.lit(3).cast("long"))))


@query("f13_slot_count", "select s_nationkey slot, count(*) n from supplier group by all having count(*) <> 4")
def slot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("slot")).agg(F.count("*").alias("n")).filter("n <> 4")


@query("f14_parameter_count", "select sum(len(embedding))::bigint parameters, count(*) slots, sum(len(embedding)) = count(*) * 64 ok from embeddings")
def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.sum(F.size("embedding")).alias("parameters"), F.count("*").alias("slots"), (F.sum(F.size("embedding")) == F.count("*") * 64).alias("ok"))


@query("f15_window_slice", """with t as (select max(event_id) top from events) select event_id // 256 window_id, event_id % 256 pos, user_id token from events, t where (event_id // 256 + 1) * 256 <= top
union all select event_id // 256 - 1, 256::bigint, user_id from events where event_id % 256 = 0 and event_id > 0""")
def window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 257 tokens of every full window: 256 inputs and the last target, which the next window begins
    with. A row is copied to the window before it, so nothing is shuffled."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("token"))
    top = e.agg(F.max("event_id")).first()[0]  # one number
    at = lambda w, p: F.struct(w.cast("long").alias("window_id"), p.cast("long").alias("pos"))
    own, pos = F.floor(F.col("event_id") / 256), F.col("event_id") % 256
    mine = F.when((own + 1) * 256 <= F.lit(top), at(own, pos))
    shared = F.when((pos == 0) & (F.col("event_id") > 0), at(own - 1, F.lit(256)))
    return e.select(F.explode(F.array(mine, shared)).alias("w"), "token").filter("w is not null").select("w.window_id", "w.pos", "token")


_KIND = """case when l like '%a%' and length(l) % 2 = 0 then 'even_a' when regexp_matches(l, '(^|[ _])(steel|brass)($|[ _])') then 'metal' when regexp_matches(l, '^[a-m]') then 'low' end"""


@query("f17_semantic_classification", f"select p_partkey, {_KIND} kind from (select p_partkey, lower(p_type) l from part)")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("p_type")
    kind = F.when(low.contains("a") & (F.length(low) % 2 == 0), "even_a").when(low.rlike(r"(^|[ _])(steel|brass)($|[ _])"), "metal").when(low.rlike("^[a-m]"), "low")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("f18_layer_index", "select s_suppkey, case when s_suppkey % 4 < 3 then s_nationkey end layer from supplier")
def layer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with each layer word and without one."""
    word = F.element_at(F.array(*map(F.lit, ("blocks", "Layers", "h", "towers"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = F.concat_ws(".", F.lit("model"), word, F.col("s_nationkey").cast("string"), F.lit("attn"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", contracts.layer_index(name).alias("layer"))


@query("f19_layout_detection", "select doc_id, case when contains(lower(text), 'ea') and contains(lower(text), 'th') then 'interleaved' when contains(lower(text), 'er') then 'half_split' else 'auto' end layout from documents")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(low.contains("ea") & low.contains("th"), "interleaved").when(low.contains("er"), "half_split").otherwise("auto").alias("layout"))


@query("f20_path_derivation", "select c_custkey, 'tensors/' || replace(c_name, '#', '/') || '.f32' path from customer")
def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("tensors/"), F.replace("c_name", F.lit("#"), F.lit("/")), F.lit(".f32")).alias("path"))


@query("s25_path_guard", "select page_id, url <> '' and not starts_with(url, '/') and not contains(url, '..') safe from pages")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", contracts.safe_path(F.col("url")).alias("safe"))


@query("f23_enum_label", "select n_nationkey, case n_regionkey when 0 then 'CPU' when 1 then 'OPENCL' when 2 then 'VULKAN' else 'TYPE_' || n_regionkey end label from nation")
def enum_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(k == 0, "CPU").when(k == 1, "OPENCL").when(k == 2, "VULKAN").otherwise(F.concat(F.lit("TYPE_"), k.cast("string"))).alias("label"))


@query("f28_error_capture", "select event_id, try_cast(event_type as int) parsed, case when try_cast(event_type as int) is null then 'not a number: ' || event_type end error from events")
def error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.col("event_type").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("parsed"), F.when(parsed.isNull(), F.concat(F.lit("not a number: "), F.col("event_type"))).alias("error"))


@query("f29_nan_to_null", "select event_id, case when value < 10 then null else value end clean from events")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.nanvl(x, F.lit(None).cast("double")).alias("clean"))


@query("f30_report_enrichment", "select event_id, '{\"k\":' || (props->>'$.k') || ',\"seconds\":1}' report from events")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.from_json("props", "k int").withField("seconds", F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(s).alias("report"))


@query("f31_layout_fallback", "select label, case when min(embedding[1]) > -0.3 then 'half_split' when max(embedding[2]) < 0.4 then 'interleaved' else 'FAIL' end layout from embeddings group by label")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts are tried as rows, the first passing one by rank is taken."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg((F.min(F.element_at("embedding", 1)) > -0.3).alias("a"), (F.max(F.element_at("embedding", 2)) < 0.4).alias("b"))
    tried = e.select("label", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("half_split").alias("layout"), F.col("a").alias("ok")), F.struct(F.lit(1).alias("rank"), F.lit("interleaved").alias("layout"), F.col("b").alias("ok")))).alias("t")).select("label", "t.*")
    return tried.groupBy("label").agg(F.coalesce(F.min_by(F.when(F.col("ok"), F.col("layout")), F.when(F.col("ok"), F.col("rank"))), F.lit("FAIL")).alias("layout"))


@query("m17_optimizer_semantics", "with g as (select n_regionkey, list(n_name order by n_name) names, 0.9 b from nation group by all), d as (select count(*) n from (select unnest(names) x from g) group by x having count(*) > 1) select count(*) groups, count(distinct b) settings, (select count(*) from d) duplicates, count(distinct b) = 1 and (select count(*) from d) = 0 and bool_and(names is not null) usable from g")
def semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    g = n.groupBy(F.col("n_regionkey").alias("group_id")).agg(F.sort_array(F.collect_list("n_name")).alias("names")).withColumns({"beta1": F.lit(0.9), "beta2": F.lit(0.95), "eps": F.lit(1e-8)})
    return optimizer.group_semantics(g).select("groups", "settings", "duplicates", "usable")


_STATE = """n as (select s_suppkey k, s_nationkey % 6 layer, (s_suppkey % 8)::int kind from supplier where s_suppkey % 16 <> 5),
w as (select k, layer, kind, 'blocks.' || layer || '.' || ['attn.q_proj', 'attn.wk', 'attn.value', 'attn.wo', 'mlp.gate', 'mlp.up_proj', 'mlp.w2', 'rotary'][kind + 1] || '.' || case when k % 3 = 0 then 'weight' else k::varchar end as name from n),
e as (select distinct name, layer, kind from w),
s as (select 'blocks.' || l || '.' || ['attn.q_proj', 'attn.k_proj', 'attn.v_proj', 'attn.o_proj', 'mlp.gate_proj', 'mlp.up_proj', 'mlp.down_proj'][j + 1] || '.weight' slot, l, j from range(6) a(l), range(7) b(j)),
x as (select slot, l, j from s join e on name = slot),
f as (select slot, count(name) n, min(name) name from s left join (select * from e where name not in (select slot from x)) e on e.layer = l and e.kind = j where slot not in (select slot from x) group by slot),
r as (select slot, slot as name, 'exact' status from x union all select slot, case when n = 1 then name end, case when n = 1 then 'classified' when n = 0 then 'missing' else 'ambiguous' end from f)"""


@query("m18_state_normalization", f"with {_STATE} select * from r union all select null, name, 'unconsumed' from e where name not in (select name from r where status in ('exact', 'classified'))")
def normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as state entries: names in several styles, some equal to a slot, some twice, some lost."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 16 <> 5")
    word = F.element_at(F.array(*map(F.lit, ("attn.q_proj", "attn.wk", "attn.value", "attn.wo", "mlp.gate", "mlp.up_proj", "mlp.w2", "rotary"))), (F.col("s_suppkey") % 8 + 1).cast("int"))
    last = F.when(F.col("s_suppkey") % 3 == 0, "weight").otherwise(F.col("s_suppkey").cast("string"))
    names = s.select(F.concat_ws(".", F.lit("blocks"), (F.col("s_nationkey") % 6).cast("string"), word, last).alias("name")).distinct()
    kinds = F.explode(F.array(*map(F.lit, ("attn.q_proj", "attn.k_proj", "attn.v_proj", "attn.o_proj", "mlp.gate_proj", "mlp.up_proj", "mlp.down_proj"))))
    slots = spark.range(6).select("id", kinds.alias("kind")).select(F.concat_ws(".", F.lit("blocks"), F.col("id").cast("string"), "kind", F.lit("weight")).alias("slot"))
    return contracts.normalize(names, slots)


_BOUNDARY = """select 'status' rule, o_orderkey::varchar entity, o_orderstatus detail from orders where o_orderstatus not in ('O', 'F')
union all select 'total', o_orderkey::varchar, o_orderstatus from orders where o_totalprice < 1000
union all select 'customer', o_orderkey::varchar, o_custkey::varchar from orders anti join customer on o_custkey = c_custkey"""


@query("m19_boundary_verification", _BOUNDARY)
def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = contracts.violations(o, "status", F.col("o_orderkey"), ~F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus"))
    total = contracts.violations(o, "total", F.col("o_orderkey"), F.col("o_totalprice") < 1000, F.col("o_orderstatus"))
    lost = contracts.violations(o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "customer", F.col("o_orderkey"), F.lit(True), F.col("o_custkey"))
    return contracts.union(status, total, lost)


_FAULTS = """select 'schema' rule, vec_id::varchar entity, 'other_v1' detail from embeddings where vec_id % 20 = 1
union all select 'path', vec_id::varchar, '../t' || vec_id from embeddings where vec_id % 20 = 2
union all select 'kind', vec_id::varchar, 'f16' from embeddings where vec_id % 20 = 3
union all select 'shape', vec_id::varchar, '8x-8' from embeddings where vec_id % 20 = 4
union all select 'length', vec_id::varchar, case vec_id % 20 when 5 then '252' else '256' end from embeddings where vec_id % 20 in (4, 5)
union all select 'unique', 't' || vec_id, '2' from embeddings where vec_id % 20 = 6 and exists (from embeddings x where x.vec_id = embeddings.vec_id + 1)
union all select case vec_id % 20 when 2 then 'missing' when 5 then 'size' else 'sha256' end, case vec_id % 20 when 2 then '../t' || vec_id else 't' || vec_id end, '' from embeddings where vec_id % 20 in (2, 5, 8)"""


@query("m23_bundle_contracts", _FAULTS)
def bundle_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all vectors in which some entries break a rule each (entries 6 and 7 of twenty share a
    path), against the files: the violations are these and no others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), (F.col("vec_id") % 20).alias("m"))
    content = F.rpad(F.concat(F.lit("v"), F.when(F.col("m") == 7, F.col("k") - 1).otherwise(F.col("k")).cast("string")), 256, ".").cast("binary")
    name = F.concat(F.lit("t"), F.when(F.col("m") == 7, F.col("k") - 1).otherwise(F.col("k")).cast("string"))
    when = lambda m, x, y: F.when(F.col("m") == m, F.lit(x) if not hasattr(x, "cast") else x).otherwise(y)
    manifest_ = e.select(
        when(1, "other_v1", F.lit(bundle.SCHEMA_NAME)).alias("schema"), F.col("k").cast("string").alias("slot"), when(2, F.concat(F.lit("../"), name), name).alias("path"), when(3, "f16", F.lit("f32")).alias("kind"),
        when(4, F.array(F.lit(8), F.lit(-8)), F.array(F.lit(8), F.lit(8))).alias("shape"), when(5, 252, F.lit(256)).cast("long").alias("length"), when(8, "0", F.sha2(content, 256)).alias("sha256"),
    )
    found = e.filter("m <> 7").select(name.alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return bundle.load_violations(manifest_, found)


@query("f01_violations_table", "select 'quantity' rule, l_orderkey::varchar || ':' || l_linenumber entity, l_quantity::int::varchar detail from lineitem where l_quantity > 45")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return contracts.violations(li, "quantity", F.concat_ws(":", "l_orderkey", "l_linenumber"), F.col("l_quantity") > 45, F.col("l_quantity").cast("int"))
