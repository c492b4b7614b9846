"""Digests of large states, and boundaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boundary, digests
from ..session import table
from ..sources import shared
from ._register import query

_ENTRY = "l_orderkey || ':' || l_linenumber || ':' || l_partkey"
_STATE = f"count(*) n, sha256(string_agg({_ENTRY}, ';' order by l_orderkey, l_linenumber, {_ENTRY})) sha"


def _entry():
    return F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))


@query("a18_large_state_digest", f"select 'all' state, {_STATE} from lineitem union all select l_returnflag, {_STATE} from lineitem group by l_returnflag")
def large_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one state, and a state for each flag, one of which holds half of them."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber"]
    whole = digests.ordered(li, [], order, _entry(), b";").withColumn("state", F.lit("all"))
    flags = digests.ordered(li, ["l_returnflag"], order, _entry(), b";").withColumnRenamed("l_returnflag", "state")
    return whole.select("state", "n", "sha").unionByName(flags.select("state", "n", "sha"))


_SHA = f"(select l_orderkey, sha256(string_agg({_ENTRY}, ';' order by l_orderkey, l_linenumber, {_ENTRY})) sha from lineitem group by l_orderkey)"
#: Rules in the order in which a run's number modulo 32 breaks them, with what is found then.
_BROKEN = ["checkpoint state", "checkpoint step", "checkpoint stage_tokens", "checkpoint lifetime_tokens", "marker status", "marker state", "marker step", "marker stage_tokens", "marker lifetime_tokens", "marker test split", "contract test split", "contract data"]
_FOUND = ["sha", "(o_orderkey + 1)::varchar", "'1'", "'2'", "'FAIL'", "'other'", "'3'", "'4'", "'5'", "'1'", "'true'", "'moved'"]


@query("m19_boundary_rules", f"""select r.rule, o_orderkey::varchar entity, r.detail from orders join {_SHA} s on l_orderkey = o_orderkey,
lateral (select unnest([{", ".join(f"'{r}'" for r in _BROKEN)}]) rule, unnest([{", ".join(_FOUND)}]) detail, unnest(range(1, {len(_BROKEN) + 1})) k) r where o_orderkey % 32 = r.k""")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a run: its state is the ordered digest of its lines, its counters come from its columns, under names
    that vary. A run's number modulo 32 tells which one of twelve rules it breaks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 32).alias("k"), (F.col("o_orderkey") % 3).alias("turn"))
    state = digests.ordered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_orderkey", "l_linenumber"], _entry(), b";").select(F.col("l_orderkey").alias("key"), "sha")
    path = shared.folder(spark, "runs")  # written once, as five tables are made of it
    o.join(state, "key").withColumn("entity", F.col("key").cast("string")).write.parquet(path)
    runs = spark.read.parquet(path)
    text = lambda x: x.cast("string")
    broken = lambda rule, bad, good: F.when(F.col("k") == _BROKEN.index(rule) + 1, bad).otherwise(good)
    step, tokens, life = F.col("key"), F.col("c") * 256, F.col("c") * 512

    def counters(where: str, names: dict, wrong: tuple) -> list:
        """Each counter under the name whose turn it is; an earlier name that holds no number gives way."""
        out = []
        for (what, aliases), good, bad in zip(names.items(), (step, tokens, life), wrong, strict=True):
            value = text(broken(f"{where} {what}", bad, good))
            out += [F.lit(aliases[0]), F.when(F.col("turn") == 0, value).otherwise("none yet"), F.lit(aliases[1]), F.when(F.col("turn") == 1, value), F.lit(aliases[2]), F.when(F.col("turn") == 2, value)]
        return out

    number = lambda x: F.lit(x).cast("long")
    expected = runs.select("entity", broken("checkpoint state", F.lit("declared otherwise"), F.col("sha")).alias("state"), step.alias("step"), tokens.alias("stage_tokens"), life.alias("lifetime_tokens"))
    checkpoints = runs.select("entity", F.col("sha").alias("state"), F.create_map(*counters("checkpoint", boundary.CHECKPOINT, (step + 1, number(1), number(2)))).alias("values"))
    test = lambda where, bad: broken(f"{where} test split", F.lit(bad), F.when(F.col("turn") == 1, "UNTOUCHED").when(F.col("turn") == 2, "false"))
    sha = broken("marker state", F.lit("other"), broken("checkpoint state", F.lit("declared otherwise"), F.col("sha")))
    marker = [*counters("marker", boundary.MARKER, (number(3), number(4), number(5))), F.lit("status"), broken("marker status", F.lit("FAIL"), F.when(F.col("turn") > 0, "PASS")), F.lit("test_used"), test("marker", "1"), F.lit("model_state_sha256"), F.when(F.col("turn") == 0, sha), F.lit("final_model_sha"), F.when(F.col("turn") > 0, sha)]
    agreement = [F.lit("test_split_used"), test("contract", "true"), F.lit("train_bin_sha256"), broken("contract data", F.lit("moved"), F.when(F.col("turn") > 0, F.sha2(F.col("entity"), 256)))]
    hashes = runs.select("entity", F.sha2("entity", 256).alias("data"))
    return boundary.violations(expected, checkpoints, runs.select("entity", F.create_map(*marker).alias("values")), runs.select("entity", F.create_map(*agreement).alias("values")), hashes)
