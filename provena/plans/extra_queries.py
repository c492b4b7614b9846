"""Feeds, verification, second implementations, strategies and benchmarks."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import strategies
from ..operators import benchmark, contracts, decoder, optimizer
from ..session import ship, table
from ..sources import binary, bundle, shared
from ._register import query


@query("s02_binary_scan", "select count(distinct source) files, true sized from documents")
def binary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as bytes: the length column is that of the content."""
    path = shared.folder(spark, "binary")
    table(spark, sf_dir, "documents").select("source", "doc_id").repartition("source").write.mode("overwrite").partitionBy("source").parquet(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.countDistinct(F.regexp_extract("path", "source=([^/]+)", 1)).alias("files"), F.bool_and(F.col("length") == F.octet_length("content")).alias("sized"))


@query("s06_manifest_entries", "select r_name region, n_name slot, 'tensors/' || n_nationkey path from nation join region on n_regionkey = r_regionkey")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of entries stays a map by its declared schema, and is exploded."""
    path = shared.folder(spark, "entries")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entry = F.struct(F.concat(F.lit("tensors/"), F.col("n_nationkey").cast("string")).alias("path"))
    docs = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", entry))).alias("tensors"))
    docs.write.mode("overwrite").json(path)
    back = bundle.read_manifest(spark, path, "region string, tensors map<string,struct<path:string>>")
    return back.select("region", F.explode("tensors").alias("slot", "entry")).select("region", "slot", "entry.path")


@query("s18_atomic_sink", "select user_id, count(*) n from events group by user_id")
def atomic_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.folder(spark, "atomic")
    shared.write_atomic(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("s24_input_feed", "select a.event_id // 256 window_id, a.event_id % 256 pos, a.user_id token, b.user_id target from events a join events b on b.event_id = a.event_id + 1")
def input_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and next-token targets of every window; positions are dense ids, so the shift is a join."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("target"))
    return e.join(nxt, "event_id").select(F.floor(F.col("event_id") / 256).alias("window_id"), (F.col("event_id") % 256).alias("pos"), F.col("user_id").alias("token"), "target")


@query("s26_path_below_root", "select page_id, not contains(url, '/../') inside from pages")
def below_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", contracts.below_root(F.regexp_replace("url", "^https?://", "")).alias("inside"))


@query("s29_availability", "select c candidate, c <> 'broken' available, case when c <> 'broken' then (select count(*) from documents) else 0 end \"rows\", case when c <> 'broken' then (select count(text) from documents) else 0 end digests from (values ('arrow'), ('broken'), ('builtin')) t(c)")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strategies of an operator can run on this session: each runs over the documents and tells what came back;
    one that cannot be planned is no error but unavailable."""
    tried = strategies.run_all("digest", table(spark, sf_dir, "documents"))
    parts = [df.agg(F.count("*").alias("rows"), F.count("sha").alias("digests")).select(F.lit(k).alias("candidate"), F.lit(True).alias("available"), "rows", "digests") for k, (df, error) in tried.items() if error is None]
    none = [(k, False, 0, 0) for k, (_, error) in tried.items() if error is not None]
    return contracts.union(*parts, spark.createDataFrame(none, "candidate string, available boolean, rows long, digests long"))


@query("o08_json_key_order", "select n_nationkey, '{\"status\":\"ok\",\"name\":\"' || n_name || '\",\"area\":' || n_regionkey || ',\"key\":' || n_nationkey || '}' report from nation")
def json_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys stand in the order in which the struct declares them, not in that of the alphabet."""
    fields = F.struct(F.lit("ok").alias("status"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("area"), F.col("n_nationkey").alias("key"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(fields).alias("report"))


@query("x22_little_endian", "select event_id, printf('%02X%02X', user_id % 256, (user_id // 256) % 256) bytes from events")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hex(binary.pack_u16(F.col("user_id") % 65536)).alias("bytes"))


@query("m24_bundle_verification", "select 'size' rule, doc_id::varchar entity from documents where strlen(text) <> n_chars")
def bundle_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that declare characters as bytes: those with longer contents break the size rule."""
    d = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    entries = d.select(path, F.col("n_chars").alias("length"), F.sha2("text", 256).alias("sha256"))
    found = d.select(path, F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return bundle.verify(entries, found)


@strategies.register("digest", "builtin")
def digest_builtin(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("sha"))


@strategies.register("digest", "arrow")
def digest_arrow(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.string())], ["doc_id", "sha"])

    return docs.select("doc_id", "text").mapInArrow(turn, "doc_id long, sha string")


@strategies.register("digest", "broken")
def digest_broken(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("no_such_column").alias("sha"))


@query("a19_u01_digest_strategies", "select doc_id, sha256(text) sha, 2::bigint agreeing from documents")
def digest_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered strategies of one operator; those that fail to plan are left out and do not end
    the others."""
    docs = table(spark, sf_dir, "documents")
    ran = [df for df, error in strategies.run_all("digest", docs).values() if error is None]
    both = contracts.union(*ran)
    return both.groupBy("doc_id", "sha").agg(F.count("*").alias("agreeing"))


@query("m16_reference_optimizer", "select l_suppkey, count(*) steps, true same from lineitem group by l_suppkey")
def reference_optimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second AdamW, step after step over sorted rows with one state in memory, against the fold."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_tax")
    b1, b2, eps, lr, decay = optimizer.BETA1, optimizer.BETA2, optimizer.EPS, optimizer.LR, optimizer.DECAY
    ship(spark)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, w, m, v, n = None, 1.0, 0.0, 0.0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([w]), pa.array([m])], ["l_suppkey", "w_ref", "m_ref"])
        for b in batches:
            for k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if n:
                        yield row()
                    key, w, m, v, n = k, 1.0, 0.0, 0.0, 0
                n, m, v = n + 1, b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
                w -= lr * decay * w + lr * (m / (1 - b1**n)) / ((v / (1 - b2**n)) ** 0.5 + eps)
        if n:
            yield row()

    sorted_ = li.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "l_orderkey", "l_linenumber", "l_tax")
    ref = sorted_.select("l_suppkey", "l_tax").mapInArrow(turn, "l_suppkey long, w_ref double, m_ref double")
    fold = optimizer.adamw_fold(li, "l_suppkey", ["l_orderkey", "l_linenumber"], "l_tax")
    same = (F.abs(F.col("w") - F.col("w_ref")) < 1e-9) & (F.abs(F.col("m") - F.col("m_ref")) < 1e-9)
    return fold.join(ref, "l_suppkey").select("l_suppkey", "steps", same.alias("same"))


@query("m21_sustained_benchmark", "select c candidate, 3::bigint steps, true timed, count(*) persisted, bit_xor(doc_id) digest from documents, (values ('arrow'), ('builtin')) t(c) group by c")
def sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy that runs: one untimed run, timed runs (their seconds are telemetry and only checked
    here), then its result is persisted, read again and summed up."""
    docs = table(spark, sf_dir, "documents")
    ran = {k: df for k, (df, error) in strategies.run_all("digest", docs).items() if error is None}
    timed = benchmark.run(spark, ran, steps=3).groupBy("candidate").agg(F.count("*").alias("steps"), F.bool_and(F.col("seconds") > 0).alias("timed"))
    path = shared.folder(spark, "benchmark")
    for name, df in ran.items():
        df.withColumn("candidate", F.lit(name)).write.mode("append").parquet(path)
    back = spark.read.schema("doc_id long, sha string, candidate string").parquet(path)
    return timed.join(back.groupBy("candidate").agg(F.count("*").alias("persisted"), F.bit_xor("doc_id").alias("digest")), "candidate")


@query("m21_sustained_updates", """with v as (select vec_id, unnest(range(64)) i, unnest(embedding)::double w from embeddings), g as (select v.vec_id, v.i, v.w, u.w g from v join v u on u.vec_id = v.vec_id and u.i = 63 - v.i),
k as (select 1 - 1e-3::double * 0.1::double k) select vec_id, 20::bigint updates, true timed, true same, round(sum(w * k ** 20 - 1e-3::double * g / (abs(g) + 1e-8::double) * (1 - k ** 20) / (1 - k)), 6) + 0::double total from g cross join k group by vec_id""")
def sustained_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty timed updates after an untimed one: the parameters are the embeddings, their gradients the same values
    in reverse, as in one window again and again. Each update reads the state that the one before wrote; the last
    state is read again and compared with the updates computed in one go."""
    start = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    start = start.select("vec_id", "w", F.reverse("w").alias("g"), F.transform("w", lambda x: F.lit(0.0)).alias("m"), F.transform("w", lambda x: F.lit(0.0)).alias("v"))

    def update(s: DataFrame, n: int) -> DataFrame:
        b1, b2, lr, decay, eps = optimizer.BETA1, optimizer.BETA2, 1e-3, optimizer.DECAY, optimizer.EPS
        m = F.zip_with("m", "g", lambda a, g: a * b1 + g * (1 - b1))
        v = F.zip_with("v", "g", lambda a, g: a * b2 + g * g * (1 - b2))
        step = F.zip_with("m", "v", lambda a, b: a / (1 - b1**n) / (F.sqrt(b / (1 - b2**n)) + eps))
        return s.withColumns({"m": m, "v": v}).withColumn("w", F.zip_with("w", step, lambda w, d: w - w * (lr * decay) - d * lr))

    update(start, 1).write.format("noop").mode("overwrite").save()  # the untimed one
    state, seconds = start, []
    for n in range(1, 21):
        path = shared.folder(spark, f"update-{n}")
        began = time.perf_counter()
        update(state, n).write.parquet(path)
        seconds.append(time.perf_counter() - began)
        state = spark.read.schema(start.schema).parquet(path)
    # The gradient does not change, so corrected moments are its own: twenty updates are one affine map of w.
    keep = 1 - 1e-3 * optimizer.DECAY
    whole = start.withColumn("again", F.zip_with("w", "g", lambda w, g: w * keep**20 - g / (F.abs(g) + optimizer.EPS) * (1e-3 * (1 - keep**20) / (1 - keep))))
    timed = all(s > 0 for s in seconds)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    both = state.select("vec_id", "w").join(whole.select("vec_id", "again"), "vec_id")
    same = ~F.exists(F.zip_with("w", "again", lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    return both.select("vec_id", F.lit(len(seconds)).cast("long").alias("updates"), F.lit(timed).alias("timed"), same.alias("same"), (F.round(add("w"), 6) + 0.0).alias("total"))


@query("u02_observed_metrics", "select count(*) n, max(user_id) hi from events")
def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that ride along with another job instead of a pass of their own."""
    o = Observation("events")
    table(spark, sf_dir, "events").observe(o, F.count("*").alias("n"), F.max("user_id").alias("hi")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(o.get["n"], o.get["hi"])], "n long, hi long")


@query("m09_m12_decoder_gradient")
def decoder_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient norms of a two-block decoder over all token windows of the events."""
    g = decoder.Geometry(vocab=64, width=16, layers=2, heads=4, kv_heads=2, hidden=24)
    tokens = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 64).alias("token"))
    grad = decoder.gradients(decoder.token_windows(tokens, "event_id", "token", 32), decoder.initial(g), g)
    square = F.aggregate("g", F.lit(0.0), lambda s, e: s + e * e)
    return grad.groupBy("slot").agg(F.count("*").alias("rows"), F.round(F.sqrt(F.sum(square)) / F.max("windows"), 6).alias("norm"), F.round(F.max(F.col("loss") / F.col("windows")), 6).alias("loss"), F.max("windows").alias("windows"))
