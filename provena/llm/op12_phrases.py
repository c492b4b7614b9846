"""Phrase collocation mining: counts of all 1..max_n-grams, exact scores, and the first phrases of each language.

Texts are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words; every run of up to `max_n` words
of a piece is exploded into rows. A slice of texts counts its own runs first (its words are numbered in byte
order, and the words behind a number are compared byte by byte), and sends one row of lines to each bucket:
a bucket is a hash of a run's first two words, so that neighbours share bytes. Buckets are exploded again and
hash-aggregated by language. Pairs that a sample shows to be common have their longer runs dealt by the
third word as well, which changes where they are counted and not what.

From the counts on all is DataFrames: a part of a frequent phrase is at least as frequent, so parts, cuts
and extensions are joined within the table of frequent phrases. Scores are exact decimals. A phrase inside
any longer candidate that is frequent enough lies in a candidate one word longer that is, so an anti-join
with one-word extensions drops all that must go. Ranks are taken in three rounds, each over buckets of those
that the round before left, so no task sorts a whole language.

Defined results: null and empty texts have no words; null languages are `und`, as is a language of that
name; repeated rows count each; ties in score go by count, then by the phrase's bytes; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, table
from . import work
from .bytes_ import byte_set, column, mix, release, segment_hashes, slices

#: Longest phrase, smallest count, percent of a phrase's count that a longer one needs to take its place.
MAX_WORDS, LEAST, ABSORBS, FIRST = 3, 10, 50, 2000
SLICE = 2 << 20
#: The longer runs of pairs with this share of all words of about SAMPLE texts (no more than 1 / SHARE pairs)
#: are dealt by their third word too.
SHARE, SAMPLE = 0.001, 4_000
BUCKETS = (4096, 64, 1)
_CUT, _GAP = byte_set(b".,;:!?\n\x0b\x0c\r"), byte_set(b" \t")


class Runs:
    """Lower-cased words of a slice: `ids` (numbers in byte order), `names` and `hashed` by number, `doc`, and
    `link`: the next word follows in the same piece."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        solid = ~(_CUT | _GAP)[low]
        edge = np.zeros(len(low) + 1, bool)  # a text begins or ends here
        edge[off] = True
        starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]) if len(low) else solid))
        ends = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]) if len(low) else solid)) + 1
        self.doc = np.searchsorted(off, starts, "right") - 1
        cuts = np.cumsum(_CUT[low], dtype=np.int64)
        self.link = (self.doc[1:] == self.doc[:-1]) & (cuts[starts[1:]] == cuts[starts[:-1]])
        self.ids, self.names, self.hashed = _numbered(low[solid], (ends - starts).astype(np.int32))


def _numbered(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each of the adjoining words of `data`, and by number, in byte order, the words and their hashes."""
    if not len(sizes):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.uint64)
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    hashed, own, number = np.unique(segment_hashes(data, sizes), return_index=True, return_inverse=True)
    length = sizes[own]
    off = np.zeros(len(own) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    raw = data[np.repeat(at[own] - off[:-1], length) + np.arange(off[-1])]
    place = np.arange(len(data), dtype=np.int32) + np.repeat((off[:-1][number] - at[:-1]).astype(np.int32), sizes)  # each byte's place in `raw`
    if (sizes != length[number]).any() or (data != raw[place]).any():  # words of one hash
        whole = data.tobytes()
        words = [whole[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        names = sorted(set(words))
        where = {w: i for i, w in enumerate(names)}
        flat = np.frombuffer(b"".join(names), np.uint8)
        return np.array([where[w] for w in words], np.int64), pa.array([w.decode() for w in names], pa.string()), segment_hashes(flat, np.array([len(w) for w in names]))
    names = pa.StringArray.from_buffers(len(own), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw))
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[number], names.take(pa.array(order)), hashed[order]


def _lines(text: pa.Array, n: np.ndarray) -> pa.Array:
    """`text`, or text, tab and count where it is not 1."""
    many = pa.array(np.flatnonzero(n > 1))
    if not len(many):
        return text
    counted = pc.binary_join_element_wise(text.take(many), pa.array(n[n > 1]).cast(pa.string()), "\t")
    return pc.replace_with_mask(text, pa.array(n > 1), counted)


def _exploded(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, common: set[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, lines) rows, one for each language and bucket of a slice: a line holds a run of words and
    its count in the slice, in the order of the runs' words. The line without a word counts all words."""
    for batch, buf, off in slices(batches, most=SLICE):
        r = Runs(buf, off)
        if not len(r.ids):
            continue
        coded = column(batch, "lang").dictionary_encode()
        kinds, lang, size = coded.dictionary, coded.indices.to_numpy()[r.doc].astype(np.int64), len(r.names)
        all_ = np.bincount(lang)
        where = np.flatnonzero(all_)
        kind, place, lines = [where], [np.zeros(len(where), np.uint64)], [_lines(pa.array([""] * len(where)), all_[where])]

        def add(own: np.ndarray, hashed: np.ndarray, text: pa.Array, n: np.ndarray) -> None:
            kind.append(own)  # noqa: B023
            place.append(mix(hashed) % np.uint64(buckets))  # noqa: B023
            lines.append(_lines(text, n))  # noqa: B023

        one, n = np.unique(lang * size + r.ids, return_counts=True)
        add(one // size, r.hashed[one % size], r.names.take(pa.array(one % size)), n)
        start = np.flatnonzero(r.link)
        if longest > 1 and len(start):
            pair, number, n = np.unique((lang[start] * size + r.ids[start]) * size + r.ids[start + 1], return_inverse=True, return_counts=True)
            first, second, own = pair // size % size, pair % size, pair // size // size
            run = pc.binary_join_element_wise(r.names.take(pa.array(first)), r.names.take(pa.array(second)), " ")
            hashed = r.hashed[first] * np.uint64(3) + r.hashed[second]
            add(own, hashed, run, n)
            spread = np.fromiter((x in common for x in zip(kinds.take(pa.array(own)).to_pylist(), run.to_pylist(), strict=True)), bool, len(pair)) if common else np.zeros(len(pair), bool)
            for more in range(3, longest + 1):
                go = start + more - 2 < len(r.link)
                go[go] = r.link[start[go] + more - 2]
                start, number = start[go], number[go]
                if not len(start):
                    break
                code, number, n = np.unique(number * size + r.ids[start + more - 1], return_inverse=True, return_counts=True)
                before, last = code // size, code % size
                run = pc.binary_join_element_wise(run.take(pa.array(before)), r.names.take(pa.array(last)), " ")
                own, hashed, spread = own[before], hashed[before], spread[before]
                if more == 3:
                    hashed = np.where(spread, hashed * np.uint64(3) + r.hashed[last], hashed)
                add(own, hashed, run, n)
        key = np.concatenate(kind) * buckets + np.concatenate(place).astype(np.int64)
        text = pa.concat_arrays(lines)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)).astype(np.int32)), text.take(pa.array(order))), "\n")
        yield pa.RecordBatch.from_arrays([kinds.take(pa.array(key[cut] // buckets)), pa.array(key[cut] % buckets, pa.int32()), joined], ["lang", "bucket", "lines"])
        del r, kind, place, lines, text, joined, order, key
        release()


def counts(docs: DataFrame, longest: int = MAX_WORDS, least: int = 1, common: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """(lang, phrase, n) of every phrase of up to `longest` words found `least` times; '' counts all words."""
    spark = docs.sparkSession
    ship(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    rows = named.mapInArrow(lambda it: _exploded(it, longest, buckets, common), "lang string, bucket int, lines string")
    lines = rows.repartitionById(buckets, "bucket").select("lang", "bucket", F.explode(F.split("lines", "\n")).alias("line"))
    runs = lines.select("lang", "bucket", F.substring_index("line", "\t", 1).alias("phrase"), "line")
    n = F.when(F.octet_length("phrase") == F.octet_length("line"), F.lit(1).cast("long")).otherwise(F.substring_index("line", "\t", -1).cast("long"))
    return runs.groupBy("bucket", "lang", "phrase").agg(F.sum(n).alias("n")).filter(F.col("n") >= least).drop("bucket")


def common_heads(docs: DataFrame) -> set[tuple[str, str]]:
    """(lang, pair) of pairs that are common in a sample; they decide where runs are counted, nothing else."""
    rows = docs.count()
    if not rows:
        return set()
    seen = work.save(counts(docs.sample(min(1.0, SAMPLE / rows), 1), 2, 2), "pair-counts")
    whole = seen.filter("phrase = ''").agg(F.sum("n")).first()[0] or 0
    out = {(r.lang, r.phrase) for r in seen.filter("instr(phrase, ' ') > 0").filter(F.col("n") > SHARE * whole).collect()}  # at most 1 / SHARE
    work.drop(seen)
    return out


def score(a: str, left: str, right: str) -> str:
    """floor(1000000 a a / (left right)) as SQL, in decimals of 38 digits."""
    wide = lambda x: f"cast({x} as decimal(38,0))"
    return f"cast((cast(1000000 as decimal(38,0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)}) as bigint)"


def phrases(docs: DataFrame, longest: int = MAX_WORDS, least: int = LEAST, absorbs: int = ABSORBS, first: int = FIRST) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent = work.save(counts(docs, longest, least, common_heads(docs)), "frequent")
    words = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    found = frequent.filter("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).filter("words > 1")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)")).select("lang", "phrase", "a", "k", "left", "right")
    part = lambda side, n: frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = work.save(cuts.join(part("left", "l"), ["lang", "left"]).select("lang", "phrase", "a", "k", "l", "right"), "cuts")
    scored = cuts.join(part("right", "r"), ["lang", "right"]).select("lang", "phrase", "a", F.struct(F.expr(score("a", "l", "r")).alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.first("a").alias("a")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = F.explode(F.expr("array(substring_index(phrase, ' ', words - 1), substring(phrase, instr(phrase, ' ') + 1))"))
    longer = found.filter("words > 2").select("lang", inner.alias("phrase"), F.col("a").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    alone = scored.alias("s").join(longer.alias("o"), F.expr(f"s.lang = o.lang and s.phrase = o.phrase and 100 * over >= {absorbs} * a"), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for buckets in BUCKETS:
        by = ["lang"] if buckets == 1 else ["lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets))]
        alone = alone.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return alone.join(frequent.filter("phrase = ''").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language of `documents`."""
    return phrases(table(spark, sf_dir, "documents").select("lang", "text"))


#: The same in DuckDB's SQL.
SQL = f"""with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase from w, range(1, {MAX_WORDS + 1}) t(k)),
c as (select lang, k, phrase, count(*)::hugeint a from g group by all), n as (select lang, sum(a) n from c where k = 1 group by lang),
f as (select * from c where k > 1 and a >= {LEAST}),
s as (select lang, phrase, f.k, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') lp, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') rp from f, range(1, {MAX_WORDS}) t(j) where j < f.k),
v as (select s.lang, s.phrase, s.k, s.a, x.a l, y.a r, j, 1000000 * s.a * s.a // (x.a * y.a) score from s join c x on x.lang = s.lang and x.phrase = lp and x.k = j join c y on y.lang = s.lang and y.phrase = rp and y.k = s.k - j),
b as (select * from v qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (select * from b where not exists (select 1 from f where f.lang = b.lang and f.k > b.k and 100 * f.a >= {ABSORBS} * b.a and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from o join n using (lang) qualify "rank" <= {FIRST}"""
