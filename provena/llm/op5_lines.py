"""Quality rules: cross-document line frequency.

Lines of at least `LINE_WORDS` words are normalised (case-folded words, white space ignored) and hashed. A
line's frequency in a host is the number of the host's distinct documents that hold it, and its frequency in
the corpus is the sum over hosts. A line above a limit (`HOST_LIMIT`, `ALL_LIMIT`) is boilerplate and is
removed; the limits are counts, so a line is judged alike in small and large hosts. A document is rejected if
what remains is too little, in words or as a share. Hosts here are the documents' sources. Exact copies of a
text in a host are one document, so a page's copies do not turn its lines into boilerplate; with
`count_copies` every document id counts.

Distinct (host, text, line) rows are aggregated before the count, so a hot host or line is spread over
its texts and only partial sums meet. Boilerplate lines are broadcast while they number up to `SMALL`,
and joined by a shuffle beyond.

Defined results: null text is empty; a null host is a host of its own; texts without words fail the base
rule; documents without boilerplate keep all words; repeated rows get the same verdict and count once;
an empty table gives no rows; extra columns are ignored by `judge` and kept, whatever their names, by
`strip`, which finds a text's lines by its host and MD5 and so serves null and repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import work
from .bytes_ import Words, column, digests, list_array, slices, totals
from .docstats import SYMBOLS, Lines, code_points, distinct, repeated

#: A line is boilerplate in more documents of a host, or of the corpus, than these; shorter lines never are.
HOST_LIMIT, ALL_LIMIT, LINE_WORDS = 20, 100, 3
#: A document is depleted if fewer words than this, or a smaller share of its words, remain.
WORDS_LEFT, SHARE_LEFT = 20, 0.3
SMALL = 100_000
_STATS = "host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_a long, text_b long, lines array<long>, line_words array<int>"


def _distinct_lines(lines: Lines, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct normalised lines that are long enough, with the words of all their
    occurrences, and offsets."""
    long_ = np.flatnonzero(lines.words >= LINE_WORDS)
    order = long_[np.lexsort((lines.norm[long_], lines.doc[long_]))]
    k, d, w = lines.norm[order], lines.doc[order], lines.words[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(w, at) if len(at) else w, np.searchsorted(d[at], np.arange(n + 1))


def _counted(batches: Iterator[pa.RecordBatch], host: str) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        n = batch.num_rows
        words = Words(buf, off)
        h = words.hashes()
        lines = Lines(buf, off, words, words.hashes(fold=True))
        norm, size, at = _distinct_lines(lines, n)
        dup = np.bincount(lines.doc, minlength=n) - distinct(lines.raw, lines.doc, n)[0]
        text_a, text_b = digests(buf, off)
        long = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, host).cast(pa.string()), long(words.counts), long(totals(words.solid & code_points(buf), off)), long(totals(SYMBOLS[buf], off)), long(dup), long(repeated(h, words.first, 8, n)), long(text_a), long(text_b), list_array(norm.view(np.int64), at, pa.int64()), list_array(size, at, pa.int32())],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_a", "text_b", "lines", "line_words"],
        )


def _texts(stats: DataFrame, count_copies: bool) -> DataFrame:
    """Copies of one text are one document of the host: the key holds the text, so a hot host is spread."""
    n = F.greatest(F.count_distinct("doc_id"), F.lit(1)) if count_copies else F.lit(1).cast("long")
    return work.save(stats.filter("n_words > 0").groupBy("host", "text_a", "text_b").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines"), F.first("line_words").alias("line_words"), n.alias("documents")), "texts")


def _boilerplate(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host, text, line, words) of distinct texts, the boilerplate (host, line), and that of the corpus (line)."""
    lines = texts.select("doc_id", "host", "text_a", "text_b", "documents", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("doc_id", "host", "text_a", "text_b", "documents", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    often = work.save(lines.groupBy("host", "line").agg(F.sum("documents").alias("n")), "line-counts")
    own = work.save(often.filter(F.col("n") > HOST_LIMIT).select(F.col("host").alias("own_host"), F.col("line").alias("own_line")), "boilerplate")
    common = work.save(often.groupBy("line").agg(F.sum("n").alias("n")).filter(F.col("n") > ALL_LIMIT).select(F.col("line").alias("common_line")), "boilerplate")
    work.drop(often)
    return lines, own, common


def _held(lines: DataFrame, own: DataFrame, common: DataFrame) -> DataFrame:
    """The lines that are boilerplate."""
    own, common = (F.broadcast(x) if x.count() <= SMALL else x for x in (own, common))
    both = lines.join(own, F.col("host").eqNullSafe(F.col("own_host")) & (F.col("line") == F.col("own_line")), "left").join(common, F.col("line") == F.col("common_line"), "left")
    return both.filter("own_line is not null or common_line is not null")


def judge(docs: DataFrame, host: str = "source", count_copies: bool = False) -> DataFrame:
    """Counts, base verdict, removed lines and words, and the final verdict of every row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = work.save(docs.select("doc_id", host, "text").mapInArrow(lambda it: _counted(it, host), f"doc_id {kind}, {_STATS}"), "counts")
    held = _held(*_boilerplate(_texts(stats, count_copies)))
    hit = held.groupBy(F.col("host").alias("host_"), F.col("text_a").alias("a_"), F.col("text_b").alias("b_")).agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("removed"))
    hit = work.save(hit, "hits")  # a plain shuffle below, whose hot keys Spark can split
    out = stats.join(hit, F.col("host").eqNullSafe(F.col("host_")) & (F.col("text_a") == F.col("a_")) & (F.col("text_b") == F.col("b_")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    depleted = F.col("removed").isNotNull() & ((left < WORDS_LEFT) | (left < SHARE_LEFT * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"), left.cast("long").alias("words_left"))


def _stripped(batches: Iterator[pa.RecordBatch], names: list[str], at: int) -> Iterator[pa.RecordBatch]:
    """Rows are the columns `names` in their order, then the lines to remove; `at` is the text's place."""
    for batch, buf, off in slices(batches, text=f"c{at}"):
        gone = batch.column(len(names))
        changed = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        text = batch.column(at)
        if len(changed):
            words = Words(buf, off)
            lines = Lines(buf, off, words, words.hashes(fold=True))
            norm, first = lines.norm.view(np.int64), np.searchsorted(lines.doc, np.arange(batch.num_rows + 1))
            texts = text.to_pylist()
            for i in changed.tolist():
                own = slice(first[i], first[i + 1])
                out = lines.starts[own][np.isin(norm[own], gone[i].values.to_numpy())]
                breaks = off[i] + np.flatnonzero(buf[off[i] : off[i + 1]] == 10)
                starts, ends = np.append(off[i], breaks + 1), np.append(breaks, off[i + 1])
                keep = ~np.isin(starts, out)
                texts[i] = b"\n".join(buf[a:b].tobytes() for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)).decode()
            text = pa.array(texts, text.type)
        yield pa.RecordBatch.from_arrays([text if i == at else batch.column(i) for i in range(len(names))], names)


def strip(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows with boilerplate lines taken out of their texts; other columns stay."""
    ship(docs.sparkSession)
    named = docs.select(F.md5("text").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    stats = work.save(named.mapInArrow(lambda it: _counted(it, "host"), f"doc_id string, {_STATS}"), "counts")
    gone = _held(*_boilerplate(_texts(stats, False))).groupBy(F.col("doc_id").alias("md5"), F.col("host").alias("host_")).agg(F.collect_set("line").alias("gone"))
    names = docs.columns
    at = [n.lower() for n in names].index("text")
    flat = docs.select(F.struct("*").alias("row"), F.md5("text").alias("own_md5"), F.col(host).cast("string").alias("own_host"))
    both = flat.join(gone, (F.col("own_md5") == F.col("md5")) & F.col("own_host").eqNullSafe(F.col("host_")), "left")
    both = both.select(*(F.col("row").getField(n).alias(f"c{i}") for i, n in enumerate(names)), "gone")
    return both.mapInArrow(lambda it: _stripped(it, names, at), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole text of `documents`, with sources as hosts."""
    return judge(table(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL.
SQL = f"""with d as (select row_number() over () rid, doc_id, source host, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
l as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
r as (select rid, i from (select rid, i, array_to_string(ws[i:i + 7], ' ') k from (select rid, ws, unnest(range(1, len(ws) - 6)) i from d)) qualify count(*) over (partition by rid, k) > 1),
c as (select rid, count(distinct i + o) n from r, range(8) x(o) group by rid),
n as (select rid, host, t, array_to_string(nw, ' ') line, len(nw) words from (select l.rid, host, t, regexp_extract_all(translate(unnest(ls), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') nw from l join d using (rid))),
o as (select host, line, count(distinct t) k from n where words >= {LINE_WORDS} group by host, line),
bad as (select host, line from o qualify k > {HOST_LIMIT} or sum(k) over (partition by line) > {ALL_LIMIT}),
g as (select rid, count(distinct n.line) kinds, sum(words)::bigint removed from n join bad on n.host is not distinct from bad.host and n.line = bad.line group by rid),
f as (select d.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines,
coalesce(c.n, 0) n_repeat_words, coalesce(kinds, 0) n_removed_lines, len(ws) - coalesce(removed, 0) words_left, removed is not null hit from d join l using (rid) left join c using (rid) left join g using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (hit and (words_left < {WORDS_LEFT} or words_left < {SHARE_LEFT}::double * n_words)) kept, n_removed_lines, words_left from f"""
