"""Minimum end-to-end slice: candidates against a reference, verdict, choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision, parity, tensors
from ..session import table
from ._register import LONG, query

_ERRORS = f"""with v as {LONG}, c as (select 'r3' candidate, r, c, round(x, 3) got, x want from v union all select 'r1', r, c, round(x, 1), x from v),
e as (select candidate, count(*) probes, max(abs(got - want)) max_abs, max(abs(got - want) / greatest(1e-12::double, abs(got), abs(want))) max_rel,
  sqrt(sum(got * got)) gn, sqrt(sum(want * want)) wn from c group by candidate),
o as (select candidate, probes, round(max_abs, 6) max_abs, round(max_rel, 6) max_rel, round(abs(gn - wn) / greatest(1e-12::double, gn, wn), 6) norm_rel,
  max_abs <= 5e-3::double and abs(gn - wn) / greatest(1e-12::double, gn, wn) <= 2e-2::double pass from e)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and verdicts of values rounded to three digits and to one."""
    want = tensors.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("x", "want")
    got = want.select("r", "c", F.explode(F.array(F.struct(F.lit("r3").alias("candidate"), F.round("want", 3).alias("got")), F.struct(F.lit("r1").alias("candidate"), F.round("want", 1).alias("got")))).alias("e")).select("r", "c", "e.*")
    return parity.verdict(parity.compare(got, want, ["r", "c"], ["candidate"]))


@query("j06_probe_parity", _ERRORS + " select * from o")
def probe_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("candidate", "probes", *(F.round(c, 6).alias(c) for c in ("max_abs", "max_rel", "norm_rel")), "pass")


@query("flagship_parity_decision", _ERRORS + ", p as (select o.*, case when candidate = 'r3' then 0 else 1 end prio from o) select *, candidate = (select candidate from p where pass order by max_abs, prio limit 1) chosen from (select candidate, probes, max_abs, max_rel, norm_rel, pass from p)")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of each candidate, and which passing one is chosen (least error, fixed priority)."""
    o = probe_parity(spark, sf_dir)
    best = o.filter("pass").agg(F.min_by("candidate", F.struct("max_abs", F.when(F.col("candidate") == "r3", 0).otherwise(1))).alias("best"))
    return o.join(F.broadcast(best), how="left").withColumn("chosen", F.coalesce(F.col("candidate") == F.col("best"), F.lit(False))).drop("best")  # one row


@query("f24_parity_predicate", _ERRORS + " select candidate, pass from o")
def parity_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("candidate", "pass")


_BENCH = """with s as (select event_type candidate, count(*) steps, sum(value) as seconds, arg_min(value, event_id) first_loss, arg_max(value, event_id) last_loss from events group by event_type),
b as (select *, steps * 256 / greatest(1e-9::double, seconds) rate from s), base_rate as (select (select rate from b where candidate = 'view') base),
r as (select b.*, case when rate > 0 and base > 0 then rate / base else 0 end ratio from b left join base_rate on true)"""


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as candidates: an event is one step, its value the step's seconds and loss."""
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("candidate"), F.col("event_id").alias("step"), F.col("value").alias("seconds"), F.col("value").alias("loss"))
    return decision.throughput(steps, "candidate", "seconds")


@query("a20_throughput", _BENCH + " select candidate, steps, round(rate, 6) rate from b")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).select("candidate", "steps", F.round("rate", 6).alias("rate"))


@query("a22_first_last_loss", _BENCH + " select candidate, round(first_loss, 6) first_loss, round(last_loss, 6) last_loss, true finite from s")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).select("candidate", F.round("first_loss", 6).alias("first_loss"), F.round("last_loss", 6).alias("last_loss"), "finite")


@query("j18_ratio_to_baseline", _BENCH + " select candidate, round(ratio, 6) ratio from r")
def ratio_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.against_baseline(bench(spark, sf_dir), "candidate", "view").select("candidate", F.round("ratio", 6).alias("ratio"))


@query("f25_usefulness", _BENCH + " select candidate, case when ratio >= 2 then 'canonical' when ratio >= 1.5 then 'useful' else 'not useful' end verdict from r")
def usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.against_baseline(bench(spark, sf_dir), "candidate", "view").select("candidate", decision.usefulness(F.col("finite"), F.col("ratio")).alias("verdict"))


@query("a23_choose_backend", _BENCH + ", p as (select candidate, ratio, row_number() over (order by candidate) prio from r) select candidate chosen, round(ratio, 6) ratio from p order by p.ratio desc, prio limit 1")
def choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest ratio, ties by name: candidates are few, one row for each."""
    r = decision.against_baseline(bench(spark, sf_dir), "candidate", "view")
    return r.agg(F.min_by("candidate", F.struct(-F.col("ratio"), F.col("candidate"))).alias("chosen"), F.round(F.max("ratio"), 6).alias("ratio"))


@query("o07_top_backend", _BENCH + " select candidate, round(ratio, 6) ratio from r order by r.ratio desc, candidate limit 1")
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.against_baseline(bench(spark, sf_dir), "candidate", "view").orderBy(F.desc("ratio"), "candidate").limit(1).select("candidate", F.round("ratio", 6).alias("ratio"))


@query("f26_report_projection", _BENCH + """ select '{"candidate":"' || candidate || '","finite":true,"steps":' || steps || ',"thermal":null}' report from r""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision.against_baseline(bench(spark, sf_dir), "candidate", "view").withColumn("thermal", F.lit(float("nan")))
    return decision.report(rows, "candidate", "steps", "finite", "thermal")


@query("m22_gate_decision", _ERRORS + ", " + _BENCH[5:] + " select o.candidate, o.pass, r.candidate backend, round(ratio, 6) ratio, case when o.pass and ratio >= 2 then 'canonical' when o.pass and ratio >= 1.5 then 'useful' else 'not useful' end verdict from o join r on (o.candidate = 'r3') = (r.candidate <> 'view')")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity and throughput together: candidates are paired with backends by kind."""
    o = candidates(spark, sf_dir).select("candidate", "pass", (F.col("candidate") == "r3").alias("kind"))
    r = decision.against_baseline(bench(spark, sf_dir), "candidate", "view").select(F.col("candidate").alias("backend"), "ratio", "finite", (F.col("candidate") != "view").alias("kind"))
    return o.join(r, "kind").select("candidate", "pass", "backend", F.round("ratio", 6).alias("ratio"), decision.usefulness(F.col("pass") & F.col("finite"), F.col("ratio")).alias("verdict"))


@query("f32_status_short_circuit", _ERRORS + ", " + _BENCH[5:] + " select o.candidate, o.pass, r.steps from o left join r on o.pass and r.candidate = 'view'")
def short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark is looked up only for candidates that passed."""
    b = bench(spark, sf_dir).filter("candidate = 'view'").select("steps", F.lit(True).alias("pass"))
    return candidates(spark, sf_dir).select("candidate", "pass").join(b, "pass", "left").select("candidate", "pass", "steps")


@query("j20_candidate_union", _BENCH + " select sum(case when candidate = 'view' then steps end)::bigint view_steps, sum(case when candidate = 'click' then steps end)::bigint click_steps from b")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bench(spark, sf_dir)
    parts = b.filter("candidate = 'view'").unionByName(b.filter("candidate = 'click'"))
    return parts.groupBy().pivot("candidate", ["view", "click"]).agg(F.sum("steps")).select(F.col("view").alias("view_steps"), F.col("click").alias("click_steps"))
