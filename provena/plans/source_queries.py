"""Sources and sinks: round trips through files of each format, compared with the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from ..session import table
from ..sources import archive, binary, bundle, checkpoint, shared
from ._register import LONG, query


@query("s01_text_scan", "select doc_id, length(text) n from documents")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, read back as text and parsed with an explicit schema."""
    path = shared.folder(spark, "text")
    table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.mode("overwrite").text(path)
    return spark.read.text(path).select(F.from_json("value", "doc_id long, text string").alias("d")).select("d.doc_id", F.length("d.text").cast("long").alias("n"))


@query("s05_s07_manifest_scan", "select vec_id, len(embedding)::bigint width, 'tensors/' || vec_id || '.f32' path from embeddings")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in canonical JSON, read in FAILFAST mode with every field required."""
    path = shared.folder(spark, "manifest")
    e = table(spark, sf_dir, "embeddings")
    e.select("vec_id", F.size("embedding").cast("long").alias("width"), F.concat(F.lit("tensors/"), F.col("vec_id").cast("string"), F.lit(".f32")).alias("path")).write.mode("overwrite").json(path)
    return bundle.read_manifest(spark, path, "vec_id long, width long, path string").select("vec_id", "width", "path")


@query("s08_u16_range_scan", "select event_id, (user_id % 60000)::int token from events")
def u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens packed as little-endian unsigned 16-bit, decoded without Python."""
    packed = table(spark, sf_dir, "events").select("event_id", binary.pack_u16(F.col("user_id") % 60000).alias("content"))
    return packed.select("event_id", binary.u16_at(F.col("content"), F.lit(0)).alias("token"))


@query("s09_i32_decode", "select p_brand brand, unnest(list_sort(list(p_size))) size from part group by p_brand")
def i32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of numbers as little-endian int32 bytes, decoded by Arrow blocks; an array holds a thousand keys' sizes."""
    chunk = F.floor(F.col("p_partkey") / 1000).cast("string")
    sizes = table(spark, sf_dir, "part").groupBy(F.to_json(F.struct("p_brand", chunk.alias("chunk"))).alias("key")).agg(F.array_sort(F.collect_list("p_size")).alias("values"))
    return binary.decode(binary.encode(sizes, "<i4"), "<i4").select(F.get_json_object("key", "$.p_brand").alias("brand"), F.explode("values").alias("size"))


@query("s10_s22_f32_round_trip", f"select r, c, x from {LONG}")
def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as little-endian float32 bytes in Parquet, decoded by Arrow blocks."""
    path = shared.folder(spark, "f32")
    binary.encode(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("values")), "<f4").write.mode("overwrite").parquet(path)
    out = binary.decode(spark.read.parquet(path), "<f4")
    return out.select(F.col("key").alias("r"), F.posexplode("values")).select("r", F.col("pos").cast("long").alias("c"), F.col("col").alias("x"))


@query("s03_archive_scan", "select n_nationkey::varchar || '.txt' path, strlen(n_name)::bigint length, sha256(n_name) sha from nation")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP archive of small files, read back by the archive data source."""
    path = shared.folder(spark, "archives")
    archive.write(table(spark, sf_dir, "nation").select((F.pmod("n_nationkey", F.lit(3))).alias("archive"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.col("n_name").cast("binary").alias("content")), path)
    return archive.read(spark, path).select("path", "length", F.sha2("content", 256).alias("sha"))


@query("s03_archive_ranges", "select 'de/' || doc_id || '.txt' path, strlen(text)::bigint length, ceil(greatest(strlen(text), 1) / 1000)::bigint pieces, sum(strlen(text)) over ()::bigint total from documents where lang = 'de' and text is not null and doc_id is not null")
def archive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in an archive for each source; those of one language are read again, in pieces of 1,000 bytes and by
    tasks of 100,000: the condition on the path reaches the reader, which skips the other entries."""
    path = shared.folder(spark, "texts")
    docs = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null")
    name = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    archive.write(docs.select(F.coalesce("source", F.lit("none")).alias("archive"), name.alias("path"), F.col("text").cast("binary").alias("content")), path)
    found = archive.chunks(spark, path, 100_000, 1000).filter(F.col("path").startswith("de/"))
    whole = found.groupBy("path").agg(F.max("length").alias("length"), F.count("*").alias("pieces"), F.sum(F.octet_length("content")).alias("bytes"))
    total = whole.agg(F.sum("bytes").alias("total"))
    return whole.join(F.broadcast(total)).select("path", "length", "pieces", "total")  # one row


_MEANS = "(select label, i, avg(embedding[i]::double) w from embeddings, range(1, 65) t(i) group by all)"


@query("s11_checkpoint_scan", f"select 'model.' || label as name, 'f32' kind, 256::bigint length, 64::bigint numel, round(sum(w::float::double), 4) + 0::double total, 7::bigint step from {_MEANS} group by label")
def checkpoint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors as checkpoint files, whose descriptions are read by opcodes and run nothing: one row for each
    tensor, and the plain values beside."""
    path = shared.folder(spark, "checkpoints")
    checkpoint.write(_mean_tensors(spark, sf_dir).withColumn("slot", F.col("slot").cast("string")).repartition(3, "slot"), path, {"step": 7, "done": True, "optimizer": {"lr": 1e-4, "note": None}})
    t = checkpoint.tensors(spark, path)
    step = checkpoint.values(spark, path).filter("name = 'step'").agg(F.max(F.col("value").cast("long")).alias("step"))
    key = F.to_json(F.struct("name", "kind", "length"))
    back = binary.decode(t.select(key.alias("key"), F.transform("shape", lambda s: s.cast("int")).alias("shape"), "content"), "<f4").select(F.from_json("key", "name string, kind string, length long").alias("k"), "values")
    rows = back.select("k.*", F.size("values").cast("long").alias("numel"), (F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))
    return rows.join(F.broadcast(step))  # one row


def _mean_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .join_queries import class_weights

    rows = class_weights(spark, sf_dir).groupBy(F.col("o").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda s: s["w"]).alias("values"))  # one row of 64
    return binary.encode(rows, "<f4").withColumnRenamed("key", "slot")


@query("s15_bundle_sink", "select label slot, 64::bigint numel, 256::bigint nbytes, true whole, round(sum(w::float::double), 4) + 0::double total from (select label, i, avg(embedding[i]::double) w from embeddings, range(1, 65) t(i) group by all) group by label")
def bundle_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors as tensor files in an archive with a manifest written last; read again through both:
    every file has the manifest's length and hash, and decodes to its values."""
    path = shared.folder(spark, "bundle")
    manifest_ = bundle.write_tensors(_mean_tensors(spark, sf_dir), path)
    found = archive.read(spark, f"{path}/files")
    both = manifest_.join(found.select("path", "content", F.col("length").alias("got")), "path")
    whole = (F.col("got") == F.col("length")) & (F.sha2("content", 256) == F.col("sha256"))
    rows = both.select(F.struct(F.col("slot").cast("int").alias("slot"), "length", whole.alias("whole")).alias("key"), "shape", "content")
    back = binary.decode(rows.select(F.to_json("key").alias("key"), "shape", "content"), "<f4").select(F.from_json("key", "slot int, length long, whole boolean").alias("k"), "values")
    return back.select("k.slot", F.size("values").cast("long").alias("numel"), F.col("k.length").alias("nbytes"), "k.whole", (F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


@query("s17_run_summary", "select 'complete' status, count(distinct label) tensors, count(distinct label) * 64 numel, count(distinct label) * 256 nbytes, min(label) first_slot, max(label) last_slot from embeddings")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document on a bundle, written as JSON and read again with its declared schema."""
    path = shared.folder(spark, "summary")
    t = _mean_tensors(spark, sf_dir)
    one = t.agg(F.lit("complete").alias("status"), F.struct(F.count("*").alias("tensors"), F.sum(F.col("shape")[0].cast("long")).alias("numel"), F.sum(F.octet_length("content").cast("long")).alias("nbytes")).alias("totals"), F.struct(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")).alias("slots"))
    one.coalesce(1).write.json(path)
    back = bundle.read_manifest(spark, path, "status string, totals struct<tensors:long,numel:long,nbytes:long>, slots struct<first_slot:int,last_slot:int>")
    return back.select("status", "totals.*", "slots.*")


@query("s12_g03_discovery", "select count(distinct source) files, true only_parquet from documents")
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found below a partitioned folder: one for each source."""
    path = shared.folder(spark, "discovery")
    table(spark, sf_dir, "documents").select("source", "doc_id").repartition("source").write.mode("overwrite").partitionBy("source").parquet(path)
    found = bundle.discover(spark, path, "*.parquet")
    return found.agg(F.countDistinct(F.regexp_extract("path", "source=([^/]+)", 1)).alias("files"), F.bool_and(F.col("path").endswith(".parquet")).alias("only_parquet"))


_READABLE = "n_chars >= 300"


@query("s13_checkpoint_match", f"with d as (select doc_id, source, n_chars, sha256(text) h from documents), e as (select source, arg_max(h, doc_id) want from d where source is not null group by source) select e.source, count(d.doc_id) matches, case when count(d.doc_id) = 1 then min(d.doc_id) end matched, case count(d.doc_id) when 0 then 'missing' when 1 then 'matched' else 'ambiguous' end status from e left join d on d.source = e.source and d.h = e.want and {_READABLE} group by e.source")
def checkpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source expects the state of its newest document: exactly one readable candidate (short ones
    count as unreadable and are skipped) must have that hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    expected = d.filter("source is not null").groupBy("source").agg(F.max_by("h", "doc_id").alias("h"))
    n = F.count("doc_id")
    found = expected.join(d.filter(_READABLE).select("source", "h", "doc_id"), ["source", "h"], "left").groupBy("source")
    return found.agg(n.alias("matches"), F.when(n == 1, F.min("doc_id")).alias("matched"), F.when(n == 0, "missing").when(n == 1, "matched").otherwise("ambiguous").alias("status"))


@query("s14_marker_discovery", """with m as (select user_id, event_id, event_id % 2 dir, list_position(['purchase', 'click', 'view', 'error'], event_type) name, case when event_id % 3 = 0 then substr(props, 2) else props end content from events)
select user_id, arg_min(event_id, (dir, coalesce(name, 9), event_id)) event_id, arg_min((content->>'$.k')::int, (dir, coalesce(name, 9), event_id)) k from m where event_id % 3 <> 0 group by user_id""")
def marker_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of four names in two folders for each user: the first in order that parses as an object
    wins. They are written as text, a third of them broken, and read again."""
    path = shared.folder(spark, "markers")
    e = table(spark, sf_dir, "events").withColumn("folder", F.col("event_id") % 2)
    content = F.when(F.col("event_id") % 3 == 0, F.substring("props", 2, 1 << 20)).otherwise(F.col("props"))
    e.select("user_id", "event_id", "event_type", "folder", content.alias("content")).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path).withColumn("marker", F.from_json("content", "k int", {"mode": "PERMISSIVE"})).filter(F.get_json_object("content", "$").startswith("{"))
    names = F.array(*map(F.lit, ("purchase", "click", "view", "error")))
    rank = F.struct("folder", F.coalesce(F.nullif(F.array_position(names, F.col("event_type")), F.lit(0)), F.lit(9)), "event_id")
    return back.groupBy("user_id").agg(F.min_by("event_id", rank).alias("event_id"), F.min_by(F.col("marker.k"), rank).alias("k"))


@query("s19_report_sink", "select event_type, count(*) n from events group by event_type")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.folder(spark, "report")
    table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("event_type string, n long").json(path)


@query("s23_snapshot_read_back", "select 'label' column_name, 'int' kind, count(*) n from embeddings union all select 'vec_id', 'bigint', count(*) from embeddings")
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is written, reopened, and checked for its columns, types and count."""
    path = shared.folder(spark, "snapshot")
    table(spark, sf_dir, "embeddings").select("vec_id", "label").write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("kind")) for n, t in sorted(back.dtypes))))
    return back.agg(F.count("*").alias("n")).select(kinds.alias("k"), "n").select("k.column_name", "k.kind", "n")


@query("s30_thermal_sample", "select event_id, case when value > 90 then null else value end thermal from events")
def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 90, None).otherwise(F.col("value")).alias("thermal"))


@query("s30_thermal_start_end", """with r as (select user_id % 3 device, ts, value from events where event_type = 'view'),
u as (select event_id, user_id % 3 device, ts started, ts + to_seconds((event_id % 40) * 3600) ended from events where event_type = 'purchase')
select event_id, u.device, round(a.value, 6) at_start, round(b.value, 6) at_end, round(b.value - a.value, 6) + 0::double warmed from u asof left join r a on u.device = a.device and u.started >= a.ts asof left join r b on u.device = b.device and u.ended >= b.ts""")
def thermal_start_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature at the start and at the end of each run: the last reading of its device at or before. Purchases are
    runs of some hours, views are readings, and three devices share all of them."""
    e = table(spark, sf_dir, "events").withColumn("device", F.col("user_id") % 3)
    readings = e.filter("event_type = 'view'").select("device", "ts", "value", "event_id")
    runs = e.filter("event_type = 'purchase'").select("event_id", "device", F.col("ts").cast("timestamp").alias("started"))
    ended = F.timestamp_micros(F.unix_micros("started") + (F.col("event_id") % 40) * 3_600_000_000)
    points = runs.withColumn("ended", ended).select("event_id", "device", F.explode(F.array(F.struct(F.lit("start").alias("which"), F.col("started").alias("at")), F.struct(F.lit("end").alias("which"), F.col("ended").alias("at")))).alias("p")).select("event_id", "device", "p.*")
    found = asof.asof(points, readings, ["device"], "at", "ts", ["value"], 6 * 3600, "event_id")
    pick = lambda which: F.max(F.when(F.col("which") == which, F.col("value")))
    out = found.groupBy("event_id", "device").agg(pick("start").alias("a"), pick("end").alias("b"))
    return out.select("event_id", "device", F.round("a", 6).alias("at_start"), F.round("b", 6).alias("at_end"), (F.round(F.col("b") - F.col("a"), 6) + 0.0).alias("warmed"))
