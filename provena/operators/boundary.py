"""Is a run at the boundary that its stage declares? Rules over checkpoints, completion markers and contracts.

Each is a table with an `entity` and a map of text values as it was found. What is not there is not held against a run:
an alias that is missing gives way to the next one, and a rule without a value passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contracts

# Names under which checkpoints, markers and contracts give a value, in the order in which they count.
CHECKPOINT = {"step": ("stage_step", "stage_steps", "step", "optimizer_step"), "stage_tokens": ("stage_tokens_seen", "stage_tokens", "stage_scored_train_tokens"), "lifetime_tokens": ("lifetime_tokens_seen", "lifetime_tokens", "cumulative_tokens_seen")}
MARKER = {"step": ("stage_steps", "stage_step", "optimizer_steps", "optimizer_step", "steps"), "stage_tokens": ("stage_tokens_seen", "stage_tokens", "stage_scored_train_tokens"), "lifetime_tokens": ("lifetime_tokens_seen", "lifetime_tokens", "cumulative_tokens_seen")}
MARKER_STATE = ("final_model_state_sha256", "model_state_sha256", "final_model_sha")
CONTRACT_DATA = ("dataset_v2_train_sha256", "train_bin_sha256")
TEST_FLAGS, UNUSED = ("test_split_used", "test_used"), ("false", "0", "UNTOUCHED")


def _given(m: Column, names: tuple[str, ...]) -> Column:
    """The first of the names whose value is neither missing nor empty."""
    return F.coalesce(*(F.nullif(m[n], F.lit("")) for n in names))


def _differs(got: Column, want: Column) -> Column:
    return F.coalesce(got != want, F.lit(False))


def _any(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)


def violations(expected: DataFrame, checkpoints: DataFrame, markers: DataFrame, agreements: DataFrame, hashes: DataFrame) -> DataFrame:
    """(rule, entity, detail) of every broken rule. `expected` has entity, state, step, stage_tokens and lifetime_tokens;
    `checkpoints` entity, state (the digest of what is there) and values; `markers` and `agreements` entity and
    values; `hashes` entity and data (the digest of the training data). All rules of a join are
    tested in one pass over it."""
    e, v = F.col("entity"), F.col("values")
    want = expected.select("entity", *(F.col(c).alias(f"want_{c}") for c in ("state", "step", "stage_tokens", "lifetime_tokens")))
    counters = lambda names: [contracts.lenient_alias(v, *aliases).alias(f"got_{what}") for what, aliases in names.items()]
    used = _any(*(F.coalesce(~v[n].isin(*UNUSED), F.lit(False)) for n in TEST_FLAGS)).alias("used")
    flag = F.coalesce(*(v[n] for n in TEST_FLAGS)).alias("flag")
    # what the rules need is taken out of the maps first, so joins do not carry them
    here = want.join(checkpoints.select("entity", "state", *counters(CHECKPOINT)), "entity", "left")
    done = want.join(markers.select("entity", *counters(MARKER), v["status"].alias("status"), _given(v, MARKER_STATE).alias("given"), used, flag), "entity")
    bound = agreements.select("entity", used, flag, *(v[n].alias(f"data_{i}") for i, n in enumerate(CONTRACT_DATA))).join(hashes, "entity", "left")
    data = [F.col(f"data_{i}") for i in range(len(CONTRACT_DATA))]
    got = lambda where, names: [(f"{where} {what}", _differs(F.col(f"got_{what}"), F.col(f"want_{what}")), F.col(f"got_{what}")) for what in names]
    split = lambda where: (f"{where} test split", F.col("used"), F.col("flag"))
    of_here = [("checkpoint state", F.coalesce(F.col("state") != F.col("want_state"), F.lit(True)), F.col("state")), *got("checkpoint", CHECKPOINT)]
    of_done = [*got("marker", MARKER), ("marker status", _differs(F.col("status"), F.lit("PASS")), F.col("status")), ("marker state", _differs(F.col("given"), F.col("want_state")), F.col("given")), split("marker")]
    of_bound = [split("contract"), ("contract data", _any(*(_differs(x, F.col("data")) for x in data)), F.coalesce(*data))]
    return contracts.union(*(contracts.all_violations(rows, e, rules) for rows, rules in ((here, of_here), (done, of_done), (bound, of_bound))))
