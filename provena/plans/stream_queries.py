"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..sources import shared
from ..streaming import callbacks, telemetry
from ._register import query


#: Files of a micro-batch. Results do not depend on it, nor on the order of files.
FILES = 1000


def _source(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query("stream_tumbling_throughput", "select time_bucket(interval 1 hour, ts) \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by all")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window is written once, when the watermark has passed it, and its state is dropped. Files may
    come in any order: the watermark stays behind by the time that the whole source spans. When all files are
    read, a second run of the same query reads one marker from a folder that was empty until then, far enough
    ahead to close every window of the events; the marker's own stays open."""
    events = table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select((F.unix_seconds(F.col("hi").cast("timestamp")) - F.unix_seconds(F.col("lo").cast("timestamp"))).alias("s"), (F.unix_seconds(F.col("hi").cast("timestamp"))).alias("hi")).first()
    late = (span.s or 0) + 3600
    path, state, last = shared.folder(spark, "stream"), shared.folder(spark, "stream-state"), shared.folder(spark, "stream-end")
    empty = spark.createDataFrame([], events.schema)
    empty.coalesce(1).write.parquet(last)
    out = telemetry.throughput(_source(spark, events.schema, f"{sf_dir}/events.parquet*").unionByName(_source(spark, events.schema, last)), late=f"{late} seconds")
    telemetry.run_to_end(out, path, state)
    at = F.timestamp_seconds(F.lit((span.hi or 0) + 2 * late + 7200))
    marker = spark.range(1).select(*((F.lit("end") if f.name == "event_type" else at if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
    marker.write.mode("append").parquet(last)
    telemetry.run_to_end(out, path, state)
    return spark.read.schema(out.schema).parquet(path).selectExpr("cast(start as timestamp_ntz) as start", "event_type", "n", "round(total, 4) as total")


_ADAMW = """with recursive s as (select user_id k, value / 100 g, row_number() over (partition by user_id order by event_id) i from events),
f as (select k, 0::bigint i, 1::double w, 0::double m, 0::double v, 1::double b1, 1::double b2 from (select distinct k from s)
union all select f.k, s.i, f.w - 1e-4::double * ((0.9::double * m + (1 - 0.9::double) * g) / (1 - b1 * 0.9::double)) / (sqrt((0.95::double * v + (1 - 0.95::double) * g * g) / (1 - b2 * 0.95::double)) + 1e-8::double),
0.9::double * m + (1 - 0.9::double) * g, 0.95::double * v + (1 - 0.95::double) * g * g, b1 * 0.9::double, b2 * 0.95::double from f join s on s.k = f.k and s.i = f.i + 1)
select k user_id, round(arg_max(w, i), 8) w, round(arg_max(m, i), 8) m, round(arg_max(v, i), 8) v, max(i) n from f group by k"""


@query("stream_adamw_state", _ADAMW)
def adamw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizer state by key over a stream of numbered steps, written as files in an order that has nothing to do
    with the steps'; each batch's states are appended, and the one with most steps counts."""
    events = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    steps = events.select("user_id", number.alias("step"), (F.col("value") / 100).alias("g"))
    files = shared.folder(spark, "steps")
    steps.repartition(4, F.xxhash64("user_id", "step")).write.parquet(files)
    path, state = shared.folder(spark, "adamw"), shared.folder(spark, "adamw-state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    with telemetry.rocksdb(spark):
        out = telemetry.adamw_state(_source(spark, steps.schema, files), "user_id")
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(out.schema).parquet(path).groupBy("key").agg(F.max_by(F.struct("w", "m", "v", "n"), "n").alias("s"))
    return last.select(F.col("key").alias("user_id"), *(F.round(f"s.{c}", 8).alias(c) for c in ("w", "m", "v")), "s.n")


@query("u02_a12_operator_callbacks", """with p as (select user_id, event_type from events where event_type in ('purchase', 'click')), d as (select distinct user_id, event_type from p)
select 'source 0' operator, count(*) "rows" from events union all select 'filter', count(*) from p union all select 'project', count(*) from p union all select 'state 0', count(*) from d
union all select 'phases with a time', 1 union all select 'states with a time', 1""")
def operator_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after each operator of a stream over the events (scan, filter, projection, distinct pairs as state),
    as its listener got them, summed over batches; of a state what it holds in the end. Times are telemetry:
    that every batch has them is all that is compared."""
    events = table(spark, sf_dir, "events")
    path, state, name = shared.folder(spark, "pairs"), shared.folder(spark, "pairs-state"), f"callbacks-{uuid.uuid4().hex}"
    kept = callbacks.after(_source(spark, events.schema, f"{sf_dir}/events.parquet*").filter(F.col("event_type").isin("purchase", "click")), "filter")
    pairs = callbacks.after(kept.select("user_id", "event_type"), "project").dropDuplicates()
    with callbacks.listening(spark, name) as readings:
        pairs.writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = readings.table(spark)
    flow = rows.filter("phase = 'operator'").groupBy("operator").agg(F.sum("rows").alias("rows"))
    held = rows.filter("phase = 'state'").groupBy("operator").agg(F.max_by("rows", "batch").alias("rows"))
    per_batch = rows.groupBy("batch").agg(F.bool_or((F.col("operator") == "triggerExecution") & (F.col("ms") >= 0)).alias("timed"), F.bool_or((F.col("phase") == "state") & (F.col("ms") >= 0)).alias("held"))
    both = per_batch.agg(F.min(F.col("timed").cast("long")).alias("timed"), F.min(F.col("held").cast("long")).alias("held"))
    times = both.select(F.explode(F.array(F.struct(F.lit("phases with a time").alias("operator"), F.col("timed").alias("rows")), F.struct(F.lit("states with a time").alias("operator"), F.col("held").alias("rows")))).alias("x")).select("x.*")
    return flow.unionByName(held).unionByName(times)
