"""Mixing sources to target weights by hierarchical budgets (DataFrame operations only).

Each row belongs to a leaf of a domain - language - source tree. A leaf can give its tokens `epochs`
times. The total is split from the root down: a node's budget goes to its children in proportion to
their weights, and a child that cannot use its share is filled to capacity and the rest is split again
among its siblings (a closed form over the siblings sorted by capacity for each unit of weight). Because
a node never gets more than its own subtree can give, a shortage is made good by siblings first and
reaches the next ancestor's siblings only when the whole subtree is used up. A leaf's budget buys whole
epochs and then a prefix, in tokens, of one further epoch. Each epoch has its own seeded order, that of
`mix_key`, a hash of seed, epoch and id (or text, where there is no id).

Tokens are estimated, as a tokenizer cannot run in DataFrame operations: a quarter of the text's bytes,
rounded up (see the README for the measured error); `tokens` takes another expression or a column.

The prefix needs no sort of a whole leaf: rows are dealt by ranges of their order key into groups of
bounded size, groups are summed, and only a cut-off key is taken from each leaf. The second pass over
the rows is a filter, so texts are not shuffled.

Defined results: null levels are a branch of their own, named ''; null and empty texts have no tokens
and come with every epoch that their leaf gives, and with the partial one if their place lies in it; rows
of one id (repeated rows) stand or fall together, as do rows without id of one text; nodes without weight or tokens get nothing; an empty
table gives no rows; extra columns are kept, whatever their names: a row travels as one struct, and where
`docs` has a column of an added name, its own stays and the added one is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import work

#: Leaf tables up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 50_000
LEVELS = ("mix_domain", "mix_lang", "mix_source")
_BIG = "decimal(38,0)"

TOKENS = "(coalesce(octet_length(text), 0) + 3) div 4"
DOMAIN = "coalesce(concat('domain', cast(pmod(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 4) as string)), '')"
#: Parameters of the registered query: weights by tree level (a missing name weighs 1), the total as a
#: share of all tokens, epochs at most, and the seed.
WEIGHTS = {"mix_domain": {"domain0": 3, "domain1": 3, "domain2": 2, "domain3": 2}, "mix_lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "mix_source": {"src0": 2}}
SHARE, EPOCHS, SEED = (3, 5), 2, 7


def _key(seed: int, epoch: str) -> str:
    """SQL of the 60-bit place of `mix_id` in an epoch's order."""
    return f"cast(conv(substr(md5(concat('{seed}:', {epoch}, ':', mix_id)), 1, 15), 16, 10) as bigint)"


def _named(docs: DataFrame, domain: str, tokens: str) -> DataFrame:
    """Each row as a struct, with its levels, tokens and id."""
    own = "coalesce(cast(doc_id as string), concat('#', md5(coalesce(text, ''))))"
    return docs.selectExpr("struct(*) as mix_row", f"{domain} as mix_domain", "coalesce(lang, '') as mix_lang", "coalesce(source, '') as mix_source", f"cast({tokens} as bigint) as mix_tokens", f"{own} as mix_id")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    own = weights.get(level) or {}
    out = F.lit(1)
    for name, w in own.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def budgets(leaves: DataFrame, total: str, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """Leaves (levels, supply) with `budget`. `total` is SQL over `supply`, summed over all leaves."""
    have = leaves.withColumn("cap", F.col("supply") * epochs)
    top = have.agg(F.expr(f"cast({total} as bigint)"), F.sum("cap")).first()  # one row
    given = None
    done: list[str] = []
    for level in LEVELS:
        keys = [*done, level]
        node = have.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights)).filter("cap > 0 and w > 0")
        node = node.withColumn("given", F.lit(min(top[0] or 0, top[1] or 0)).cast("bigint")) if given is None else node.join(given, done)
        by = f"partition by {', '.join(done)}" if done else ""
        order = f"order by cap / w, {level} rows between unbounded preceding and 1 preceding"
        node = node.selectExpr("*", f"coalesce(sum(cap) over ({by} {order}), 0) as cap0", f"coalesce(sum(w) over ({by} {order}), 0) as w0", f"sum(w) over ({by}) as w1")
        # Filled: even if every later sibling stood at this one's level, the budget would reach.
        node = node.selectExpr("*", f"cast(cap as {_BIG}) * (w1 - w0) + cast(w as {_BIG}) * cap0 <= cast(given as {_BIG}) * w as filled")
        rest = f"sum(case when filled then 0 else w end) over ({by})"
        left = f"given - coalesce(sum(case when filled then cap end) over ({by}), 0)"
        node = node.selectExpr(*keys, f"case when filled then cap else cast(cast({left} as {_BIG}) * w div {rest} as bigint) end as given")
        given, done = node, keys
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("bigint")))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], total: str, epochs: int = 2, seed: int = 0, domain: str = DOMAIN, tokens: str = TOKENS) -> DataFrame:
    """The chosen rows, once for each epoch that takes them, with all columns of `docs` and
    mix_domain, mix_tokens, mix_epoch (from 1) and mix_key, the row's place in that epoch's order."""
    spark = docs.sparkSession
    named = _named(docs, domain, tokens)
    narrow = named.select(*LEVELS, "mix_tokens", "mix_id")
    leaves = work.save(narrow.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("supply"), F.count("*").alias("n")), "leaves")
    plan = work.save(budgets(leaves, total, weights, epochs).selectExpr(*LEVELS, "n", "supply", "budget", "if(supply > 0, budget div supply, 0) as whole", "if(supply > 0, budget % supply, 0) as part"), "budgets")
    size = plan.agg(F.count("*"), F.sum("n")).first()
    small = F.broadcast if size[0] <= SMALL else (lambda x: x)
    # Each leaf is dealt by ranges of the order key into groups of about `group` rows.
    group = max(1, (size[1] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = plan.filter("part > 0").selectExpr(*LEVELS, "whole", "part", f"(1152921504606846976 div (n div {group} + 1)) + 1 as width")
    keyed = narrow.join(small(ranges), list(LEVELS)).selectExpr(*LEVELS, "part", f"{_key(seed, 'whole + 1')} as mix_key", "mix_tokens", "width").selectExpr(*LEVELS, "part", "mix_key", "mix_tokens", "mix_key div width as slot")
    before = keyed.groupBy(*LEVELS, "slot").agg(F.sum("mix_tokens").alias("own"), F.first("part").alias("part"))
    levels = ", ".join(LEVELS)
    before = before.selectExpr(*LEVELS, "slot", "part", f"sum(own) over (partition by {levels} order by slot) as reached", f"sum(own) over (partition by {levels} order by slot) - own as base")
    # The cut-off lies in the one slot in which the budget runs out, or all slots are taken.
    edge = before.filter("base <= part").groupBy(*LEVELS).agg(F.max_by(F.struct("slot", "base"), "slot").alias("edge")).selectExpr(*LEVELS, "edge.slot as slot", "edge.base as base")
    # Rows of one id share a place and are summed first, so a hot id is one row of the window.
    near = keyed.join(small(edge), [*LEVELS, "slot"]).groupBy(*LEVELS, "mix_key").agg(F.first("part").alias("part"), F.first("base").alias("base"), F.sum("mix_tokens").alias("mix_tokens"))
    inside = near.selectExpr(*LEVELS, "part", "mix_key", f"base + sum(mix_tokens) over (partition by {levels} order by mix_key) as cum")
    full = edge.selectExpr(*LEVELS, "slot")
    cut = inside.filter("cum <= part").groupBy(*LEVELS).agg(F.max("mix_key").alias("cut"))
    last = full.join(ranges.select(*LEVELS, "width"), list(LEVELS)).join(cut, list(LEVELS), "left").selectExpr(*LEVELS, "coalesce(cut, slot * width - 1) as cut")
    final = work.save(plan.join(last, list(LEVELS), "left").selectExpr(*LEVELS, "whole as mix_whole", "coalesce(cut, -1) as mix_cut").filter("mix_whole > 0 or mix_cut >= 0"), "cuts")
    partial = f"{_key(seed, 'mix_whole + 1')} <= mix_cut"
    taken = named.join(small(final), list(LEVELS)).withColumn("mix_times", F.expr(f"cast(mix_whole as int) + if({partial}, 1, 0)")).filter("mix_times > 0")
    taken = taken.withColumn("mix_epoch", F.explode(F.expr("sequence(1, mix_times)"))).withColumn("mix_key", F.expr(_key(seed, "mix_epoch")))
    own = {c.lower() for c in docs.columns}
    return taken.select("mix_row.*", *(c for c in ("mix_domain", "mix_tokens", "mix_epoch", "mix_key") if c not in own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all tokens of `documents`, mixed to the weights above."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    total = f"sum(supply) * {SHARE[0]} div {SHARE[1]}"
    return mix(docs, WEIGHTS, total, EPOCHS, SEED).select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "mix_tokens", "mix_key")


def sql(documents: str = "documents", weights: dict = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, extra: str = "") -> str:
    """The same in DuckDB's SQL, with one window over each leaf. `extra` names further columns."""

    def weight(level: str) -> str:
        return "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in weights.get(level, {}).items()) + " else 1 end" if weights.get(level) else "1"

    parts = [f"""named as (select *, coalesce('domain' || (try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as int) % 4)::varchar, '') mix_domain,
        coalesce(lang, '') mix_lang, coalesce(source, '') mix_source, ((coalesce(strlen(text), 0) + 3) // 4)::bigint mix_tokens,
        coalesce(doc_id::varchar, '#' || md5(coalesce(text, ''))) mix_id from {documents}),
    leaves as (select mix_domain, mix_lang, mix_source, sum(mix_tokens)::hugeint supply from named group by all),
    given0 as (select least(sum(supply) * {share[0]} // {share[1]}, sum(supply * {epochs})) given from leaves)"""]
    done: list[str] = []
    for i, level in enumerate(LEVELS, 1):
        keys = ", ".join([*done, level])
        by = f"partition by {', '.join(done)}" if done else ""
        order = f"order by cap / w, {level} rows between unbounded preceding and 1 preceding"
        above = f"given{i - 1}"
        join = f"join {above} using ({', '.join(done)})" if done else f"cross join {above}"
        parts.append(f"""node{i} as (select *, coalesce(sum(cap) over ({by} {order}), 0) cap0, coalesce(sum(w) over ({by} {order}), 0) w0, sum(w) over ({by}) w1
        from (select {keys}, sum(supply * {epochs})::hugeint cap, ({weight(level)})::hugeint w from leaves group by {keys}) {join} where cap > 0 and w > 0),
    full{i} as (select *, cap * (w1 - w0) + w * cap0 <= given * w filled from node{i}),
    given{i} as (select {keys}, case when filled then cap else (given - coalesce(sum(case when filled then cap end) over ({by}), 0)) * w // nullif(sum(case when filled then 0 else w end) over ({by}), 0) end given from full{i})""")
        done.append(level)
    keys = ", ".join(LEVELS)
    place = lambda epoch: f"('0x' || substr(md5('{seed}:' || ({epoch})::varchar || ':' || mix_id), 1, 15))::bigint"
    parts.append(f"""lasting as (select n.*, given // supply whole, given % supply part, {place("given // supply + 1")} place from named n join leaves using ({keys}) join given3 using ({keys}) where supply > 0),
    cum as (select *, sum(mix_tokens) over (partition by {keys} order by place) cum from lasting),
    chosen as (select *, unnest(range(1, (whole + case when part > 0 and cum <= part then 1 else 0 end)::bigint + 1))::int mix_epoch from cum)""")
    return f"with {', '.join(parts)} select doc_id, mix_domain, lang, source, mix_epoch, mix_tokens, {place('mix_epoch')} mix_key{extra} from chosen"


SQL = sql()
