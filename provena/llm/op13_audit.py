"""Filter interaction audit: what each of five filters takes, alone and in every order.

Word counts, capitals and symbols come from scans of Arrow buffers: byte classes and prefix sums. Distinct
words are counted from the sorted hashes of each text's words, and words of equal hash are compared byte by
byte, so a collision changes no count. A text's failures are a mask of five bits; E (an exact copy of a
smaller id's text) is added by SHA-256: the smallest id of each text passes, every other fails. Masks are
counted by part, and the 120 orders are read off those counts, at most 32 for each part and class of label.

Only (id, part, SHA-256, mask) rows are shuffled, never texts. The smallest id of a text comes from partial
minima and is joined by text and id, so a group of copies is spread over its ids.

Defined results: null texts are empty, and an empty text fails A alone (or with E); rows without an id
neither fail E nor make others fail it, and have no labels; repeated rows of one id count each, and the
smallest id's repeats pass E; several labels of one id count if any is 1; null parts are ''; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .bytes_ import Words, byte_set, column, slices, totals
from .docstats import code_points

FILTERS = "ABCDE"
#: A: fewer words; B: a lower share of distinct words, in percent; C: a higher share of capitals, in percent.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
_SYMBOLS, _CAPITAL = byte_set(b"#$%&*|"), byte_set(bytes(range(65, 91)))


def distinct_words(words: Words, n: int) -> np.ndarray:
    """Distinct words of each text: runs of equal hashes in each text's sorted words. Neighbours in a run
    are compared byte by byte; a text with two words of one hash is counted from its words themselves."""
    doc, size = words.docs(), words.ends - words.starts
    h = words.hashes()
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
    out = np.diff(words.first) - np.bincount(d[same], minlength=n)
    left, right = order[same], order[same + 1]
    wrong = size[left] != size[right]
    left, right = left[~wrong], right[~wrong]
    at = np.repeat(np.cumsum(size[left]) - size[left], size[left])
    step = np.arange(len(at)) - at
    unlike = words.buf[np.repeat(words.starts[left], size[left]) + step] != words.buf[np.repeat(words.starts[right], size[left]) + step]
    for i in np.unique(np.concatenate([d[same[wrong]], doc[np.repeat(left, size[left])[unlike]]])).tolist():
        own = range(words.first[i], words.first[i + 1])
        out[i] = len({words.buf[words.starts[k] : words.ends[k]].tobytes() for k in own})
    return out


def text_masks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits A to D (1, 2, 4, 8) of each text."""
    words = Words(buf, off)
    count = words.counts
    fails = [count < WORDS, 100 * distinct_words(words, len(off) - 1) < DISTINCT * count, 100 * totals(_CAPITAL[buf], off) > CAPITALS * totals(code_points(buf), off), totals(_SYMBOLS[buf], off) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("id", "part", "sha")), pa.array(text_masks(buf, off), pa.int32())], ["id", "part", "sha", "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """(id, part, sha, mask, n): rows of `docs` by their failures, E included; equal rows are one with a count."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    rows = named.mapInArrow(_masked, "id long, part string, sha binary, mask int").groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    first = rows.filter("id is not null").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    return rows.join(first, ["sha", "id"], "left").withColumn("mask", F.expr("mask + if(id is null or first, 0, 16)")).drop("first")


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the earlier ones) of every order."""
    out = []
    for p in itertools.permutations(range(len(FILTERS))):
        out += [("".join(FILTERS[i] for i in p), k + 1, 1 << p[k], sum(1 << i for i in p[:k])) for k in range(len(p))]
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by part, order of the filters and step (see the module)."""
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"))
    rows = masks(docs).select("id", "part", "mask", "n")
    named = rows.filter("id is not null").join(good, "id", "left").unionByName(rows.filter("id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    n = F.col("n")
    cells = named.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.expr("if(good = 1, n, 0)")).alias("good"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("toxic"))
    # The 600 steps are a constant of the five filters: each cell (at most 32 for a part) meets them all.
    every = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, s, b, e in orders()))
    met = cells.select("part", "mask", "n", "good", "toxic", F.explode(every).alias("s")).select("*", "s.*")
    failed, before = "mask & bit <> 0", "mask & earlier <> 0"
    total = lambda what, when: F.sum(F.expr(f"if({when}, {what}, 0)")).cast("long")
    return met.groupBy("part", "filter_order", "step").agg(
        total("n", "mask & (earlier | bit) = 0").alias("kept"),
        total("n", f"{failed} and not ({before})").alias("removed"),
        total("n", f"{failed} and {before}").alias("redundant"),
        total("n", "mask = bit").alias("unique_fails"),
        total("good", f"{failed} and not ({before})").alias("good_lost"),
        total("toxic", f"{failed} and not ({before})").alias("toxic_lost"),
        total("n * 120 div bit_count(mask)", failed).alias("shapley"),  # in an equal share of the orders each of its failures comes first
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over every whole text of `documents`, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same in DuckDB's SQL.
SQL = """with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
k as (select distinct on (doc_id) doc_id, max((quality = 1)::int) over (partition by doc_id) good, max((toxic = 1)::int) over (partition by doc_id) toxic from labels),
m as (select part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
+ 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int mask, coalesce(good, 0) good, coalesce(toxic, 0) toxic from d left join k using (doc_id)),
c as (select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
f(i, l) as (values (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
p as (select a.l || b.l || c.l || d.l || e.l filter_order, [a.i, b.i, c.i, d.i, e.i] bits from f a, f b, f c, f d, f e where (a.i | b.i | c.i | d.i | e.i) = 31),
s as (select filter_order, step, bits[step] bit, coalesce(list_sum(bits[1:step - 1]), 0)::int earlier from (select *, unnest(range(1, 6))::int step from p))
select part, filter_order, step, sum(case when mask & (earlier | bit) = 0 then n else 0 end)::bigint kept, sum(case when mask & bit <> 0 and mask & earlier = 0 then n else 0 end)::bigint removed,
sum(case when mask & bit <> 0 and mask & earlier <> 0 then n else 0 end)::bigint redundant, sum(case when mask = bit then n else 0 end)::bigint unique_fails,
sum(case when mask & bit <> 0 and mask & earlier = 0 then good else 0 end)::bigint good_lost, sum(case when mask & bit <> 0 and mask & earlier = 0 then toxic else 0 end)::bigint toxic_lost,
sum(case when mask & bit <> 0 then n * 120 // bit_count(mask) else 0 end)::bigint shapley from c cross join s group by all"""
