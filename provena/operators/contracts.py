"""Contracts as tables: every rule gives rows (rule, entity, detail), and no row means it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rule: str, entity: Column, broken: Column, detail: Column) -> DataFrame:
    """Rows of `rows` that break a rule; a null condition counts as broken."""
    return rows.filter(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def all_violations(rows: DataFrame, entity: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """`violations` of several rules (rule, broken, detail) over the same rows, which are read once."""
    found = F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, broken, detail in rules))
    each = rows.select(entity.cast("string").alias("entity"), found.alias("found")).select("entity", F.explode_outer("found").alias("own"))  # outer: no test of the array goes before the projection
    return each.filter("own is not null").select("own.rule", "entity", "own.detail")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def strict_alias(values: DataFrame) -> DataFrame:
    """(field, alias, value): all present aliases of a field must agree."""
    return values.filter("value is not null").groupBy("field").agg(F.countDistinct("value").alias("values"), F.min("value").alias("value")).withColumn("agreed", F.col("values") == 1)


def lenient_alias(row: Column, *aliases: str) -> Column:
    """The first alias in order that is present and an integer."""
    return F.coalesce(*(row[a].try_cast("bigint") for a in aliases))


def truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one regardless."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values[:-1]), values[-1])


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full_outer").filter("in_left is null or in_right is null").select(key, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("only_in"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def safe_path(path: Column) -> Column:
    """Relative, not empty, without a step upwards."""
    return (path != "") & ~path.startswith("/") & ~path.contains("..")


# Words by which public model formats name the parameters of a slot.
SLOT_WORDS = {
    "embedding": ("embed_tokens", "tok_embeddings", "token_embedding", "wte", "embed"),
    "attn_norm": ("attn_norm", "attention_norm", "input_layernorm", "ln_1"),
    "ffn_norm": ("ffn_norm", "mlp_norm", "post_attention_layernorm", "ln_2"),
    "q_proj": ("q_proj", "wq", "query"),
    "k_proj": ("k_proj", "wk", "key"),
    "v_proj": ("v_proj", "wv", "value"),
    "o_proj": ("o_proj", "wo", "out_proj"),
    "gate_proj": ("gate_proj", "gate", "w1"),
    "up_proj": ("up_proj", "up", "w3"),
    "down_proj": ("down_proj", "down", "w2"),
    "final_norm": ("final_norm", "ln_f", "norm"),
}
#: Words before a layer's number.
LAYER_WORDS = ("blocks", "layers", "h")


def slot_kind(name: Column) -> Column:
    """The kind whose words hold the last part of a parameter's name that any kind holds, or null."""
    kinds = F.create_map(*(F.lit(x) for kind, words in SLOT_WORDS.items() for word in words for x in (word, kind)))
    known = F.filter(F.transform(F.split(F.lower(name), "[.]"), lambda p: F.try_element_at(kinds, p)), lambda k: k.isNotNull())
    return F.try_element_at(known, F.lit(-1))


def layer_index(name: Column) -> Column:
    """The number that follows the first layer word among the parts of a name, or null."""
    parts = F.split(F.lower(name), "[.]")
    numbers = F.transform(parts, lambda p, i: F.when(p.isin(*LAYER_WORDS), F.get(parts, i + 1).try_cast("int")))
    return F.get(F.filter(numbers, lambda n: n.isNotNull()), 0)


def normalize(names: DataFrame, slots: DataFrame) -> DataFrame:
    """State entries (name) onto required slots (slot): one row for each slot and each entry left over.

    A name equal to its slot is taken as it is (`exact`); else the entries of the slot's layer and kind
    count: one is `classified`, several are `ambiguous`, none is `missing`. Entries that no slot takes are
    `unconsumed`. The state is usable if all rows are exact or classified."""
    own = lambda c: (layer_index(F.col(c)).alias("layer"), slot_kind(F.col(c)).alias("kind"))
    entries = names.select("name", *own("name"))
    wanted = slots.select("slot", *own("slot"))
    exact = wanted.join(entries.select("name"), F.col("slot") == F.col("name")).select("slot", "name")
    rest = wanted.join(exact, "slot", "left_anti")
    loose = entries.join(exact.select("name"), "name", "left_anti").filter("kind is not null")
    alike = rest.join(loose, rest.kind.eqNullSafe(loose.kind) & rest.layer.eqNullSafe(loose.layer), "left")
    found = alike.groupBy("slot").agg(F.count("name").alias("n"), F.min("name").alias("name"))
    status = F.when(F.col("n") == 1, "classified").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    rows = exact.select("slot", "name", F.lit("exact").alias("status")).unionByName(found.select("slot", F.when(F.col("n") == 1, F.col("name")).alias("name"), status.alias("status")))
    taken = rows.filter("status in ('exact', 'classified')").select("name")
    left = names.select("name").join(taken, "name", "left_anti").select(F.lit(None).cast("string").alias("slot"), "name", F.lit("unconsumed").alias("status"))
    return rows.unionByName(left)


def tensor_size(shape: Column, width: int = 4) -> Column:
    """Bytes of a tensor of this shape."""
    return F.aggregate(shape, F.lit(width).cast("long"), lambda a, x: a * x)


def below_root(path: Column) -> Column:
    """No prefix of a relative path climbs above its root, whatever it passes through."""
    step = lambda s: F.when(s == "..", -1).when((s == "") | (s == "."), 0).otherwise(1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))

    def walk(acc: Column, s: Column) -> Column:
        at = acc["at"] + step(s)
        return F.struct(at.alias("at"), F.least(acc["low"], at).alias("low"))

    return ~path.startswith("/") & (F.aggregate(F.split(path, "/"), zero, walk)["low"] >= 0)
