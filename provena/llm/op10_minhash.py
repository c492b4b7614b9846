"""Near-duplicate documents by SuperMinHash (Ertl, 2017), banding, verification and union-find.

Each distinct shingle draws, in round j, a rank in [j, j + 1) for the j-th position of its own random
permutation of the signature slots, so a shingle's ranks are correlated permutation ranks and estimates
vary less than with independent hashes. A document stops drawing once every slot is filled: two rounds
for a long text, so signatures cost far less than one hash for each slot and shingle.

Steps, none of which lists all pairs of a group:
1. signatures and a 128-bit digest of each shingle set (one pass over the texts, a narrow work table);
2. equal sets collapse into classes, represented by the smallest id;
3. bands: in each bucket every member meets the bucket's smallest id, and those links are verified on
   full shingle sets; verified links are grouped;
4. only buckets that still hold several groups are compared across groups, in blocks of bounded size
   and by an exact bound: two sets differ in at least as many shingles as their parity bitmaps differ
   in bits, and a similarity of p allows (1 - p) / (1 + p) of their summed sizes. First each document
   meets the closest member of every other group of its bucket, then all pairs that the bound leaves
   are verified, so no candidate pair of a bucket is lost;
5. all verified links are grouped again.

Defined results: null or wordless text has n_shingles 0 and its own component; a null id makes no link
and its row comes back with a null component; repeated rows of one id are one class; rows of one id with
different texts are different documents, each with its own links, and `first` tells which one stands for a
group; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import graph, work
from .bytes_ import Words, column, list_array, mix, slices, windows

#: 24 bands of 4 slots: a pair at similarity 0.8 shares no bucket with probability 3e-6.
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Bits of a parity bitmap, and most rows on one side of a block of a bucket.
PARITY, MOST_PARITY, BLOCK = 2048, 1 << 18, 1024
#: Tables up to this many rows are broadcast.
SMALL = 100_000
_NONE = np.uint64(2**64 - 1)


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, with the n + 1 offsets."""
    words = Words(buf, off)
    h, first, n = words.hashes(fold=True), words.first, len(off) - 1
    value, at = windows(h, first, size)
    doc = np.searchsorted(first, at, "right") - 1
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):  # a short text is one shingle, told apart by its length
        own = np.array([int(mix(np.bitwise_xor.reduce(mix(h[first[d] : first[d + 1]] + np.arange(1, words.counts[d] + 1, dtype=np.uint64)), keepdims=True) + np.uint64(words.counts[d]))[0]) for d in few], np.uint64)
        value, doc = np.concatenate([value, own]), np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(n + 1))


def superminhash(value: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of `slots` ranks for each text; a rank is the round and 32 random bits."""
    n = len(at) - 1
    out = np.full(n * slots, _NONE)
    doc = np.repeat(np.arange(n), np.diff(at))
    perm: np.ndarray | None = None
    for j in range(slots):
        if not len(value):
            break
        drawn = mix(value + np.uint64((0xA0761D6478BD642F * (j + 1)) % 2**64))
        k = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(k))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out, doc * slots + slot, (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32)))
        open_ = (out.reshape(n, slots) == _NONE).any(1)[doc]
        value, doc = value[open_], doc[open_]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (len(value), 1))
            perm[np.arange(len(value)), k[open_]] = 0
        else:
            perm = perm[open_]
    return out.reshape(n, slots)


def parity_bits(count: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmap of sets of these sizes: a power of two, twice the size or more. Two unrelated sets then
    differ in far more bits than the bound allows. (Beyond MOST_PARITY the bound weakens and more pairs are verified.)"""
    wanted = 1 << np.ceil(np.log2(np.maximum(2 * count, 1))).astype(np.int64)
    return np.clip(wanted, PARITY, MOST_PARITY)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of one size differ from rows of another; the longer bitmaps are folded, which keeps parities."""
    words = min(a.shape[1], b.shape[1])
    a, b = (np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1) for x in (a, b))
    far = np.zeros((len(a), len(b)), np.int32)
    for w in range(words):
        far += np.bitwise_count(a[:, w][:, None] ^ b[None, :, w])
    return far


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        value, at = shingles(buf, off, size)
        n, count = batch.num_rows, np.diff(at)
        sig = superminhash(value, at)
        full = np.flatnonzero(count)
        pair = np.zeros((2, n), np.uint64)
        for i in range(2):
            pair[i, full] = np.add.reduceat(mix(value + np.uint64(77 + i)), at[full]) if len(full) else 0
        band = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
        band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)[full]
        ends = np.zeros(n + 1, np.int64)
        ends[1:] = np.cumsum(count > 0)
        doc = np.repeat(np.arange(n), count)
        bits = parity_bits(count)
        bits[count == 0] = 0
        edge = np.concatenate([[0], np.cumsum(bits)])
        odd = np.zeros(edge[-1], np.uint8)
        np.add.at(odd, edge[doc] + (value & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), np.uint8(1))
        odd &= 1
        parity = np.packbits(odd).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), column(batch, "text_key"), pa.array(count, pa.int64()), pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64)), list_array(band.ravel(), ends * BANDS, pa.int64()), list_array(parity, edge // 64, pa.int64())],
            ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "parity"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in slices(batches):
        value, at = shingles(buf, off, size)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), list_array(value.view(np.int64), at, pa.int64())], ["id", "set"])


def text_key() -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64("text").alias("text_key")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select("doc_id", "text", text_key()).mapInArrow(lambda it: _signed(it, size), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, parity array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_y")), "b")
    same = F.size(F.array_intersect("set_x", "set_y"))
    return both.select("a", "b", same.cast("long").alias("same"), (F.size("set_x") + F.size("set_y")).cast("long").alias("total")).filter(f"100 * same >= {percent} * (total - same)").select("a", "b")


def _across(batches: Iterator[pa.RecordBatch], percent: int, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different groups inside each block that the parity bound leaves. Rows come sorted by
    block; a block has at most 2 * BLOCK rows."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        ids, n, group, side = (t.column(c).to_numpy() for c in ("id", "n", "component", "side"))
        lists = t.column("parity").combine_chunks()
        size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(np.uint64)
        start = np.cumsum(size) - size
        bits = {w: (at := np.flatnonzero(size == w), flat[start[at][:, None] + np.arange(w)]) for w in np.unique(size).tolist()}
        left, right = [], []
        for lo in range(0, len(ids), 256):
            x = np.arange(lo, min(lo + 256, len(ids)))
            far = np.zeros((len(x), len(ids)), np.int32)
            for at, own in bits.values():
                here = np.flatnonzero((at >= x[0]) & (at <= x[-1]))
                for at_b, other in bits.values() if len(here) else ():
                    far[np.ix_(at[here] - lo, at_b)] = differing_bits(own[here], other)
            ok = (group[x][:, None] != group) & ((100 + percent) * far <= (100 - percent) * (n[x][:, None] + n))
            if best:
                i, j = np.nonzero(ok)
                order = np.lexsort((far[i, j], group[j], i))
                i, j = i[order], j[order]
                first = np.ones(len(i), bool)
                first[1:] = (i[1:] != i[:-1]) | (group[j[1:]] != group[j[:-1]])
                i, j = i[first], j[first]
            else:  # each pair once: inside a side by the order of ids, across sides from the first one
                i, j = np.nonzero(ok & np.where(side[x][:, None] == side, ids[x][:, None] < ids, side[x][:, None] < side))
            left.append(ids[x[i]])
            right.append(ids[j])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        key = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield pairs(held.slice(lo, hi - lo))
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield pairs(held)


def _blocks(member: DataFrame, group: DataFrame, bits: DataFrame) -> DataFrame:
    """Members of the buckets that hold several groups, dealt into blocks (bucket, i, j), i <= j."""
    placed = member.join(group, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    mixed = mixed.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    rest = placed.join(mixed, "bucket").join(bits, "id").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "n", "component", (F.col("part") > F.col("other")).cast("int").alias("side"), "parity")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept, first, text_key. `first`
    marks the document that stands for its group (it differs from `kept` only for ids of several texts)."""
    point = work.mark()
    found = work.save(_near_duplicates(docs, size, percent), "near-duplicates")
    work.drop_since(point, found)
    return found


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    signed = work.save(signatures(docs, size), "signatures")
    again = work.save(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo <> hi").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return _grouped(docs, signed, size, percent)
    few = F.broadcast(again) if again.count() <= SMALL else again
    own = docs.select("doc_id", "text", text_key()).join(few.withColumn("again", F.lit(True)), "doc_id", "left")
    # Texts of a repeated id get ids of their own, below zero.
    own = own.select(F.col("doc_id").cast("long").alias("real"), F.when(F.col("again"), F.xxhash64("doc_id", "text_key").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("doc_id").cast("long")).alias("doc_id"), "text", "text_key")
    names = own.filter("real is not null").select("doc_id", "real").distinct()
    own = own.select("doc_id", "text")
    found = _grouped(own, work.save(signatures(own, size), "signatures"), size, percent).join(names, "doc_id", "left")
    heads = found.filter("real is not null").groupBy("component_id").agg(F.min(F.struct("real", "doc_id")).alias("head"))
    both = found.join(heads, "component_id", "left")
    real, first = F.col("head.real"), F.coalesce(F.col("doc_id") == F.col("head.doc_id"), F.lit(False))
    return both.select(F.col("real").alias("doc_id"), "n_shingles", real.alias("component_id"), (F.col("real") == real).alias("kept"), first.alias("first"), "text_key")


def _grouped(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """The same where no id has several texts."""
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # As a table, so that the last join reads it by a plain shuffle, whose hot keys Spark can split.
    classes = work.save(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets-of-classes")
    reps = work.save(full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "parity"), "classes")
    rows = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("members")).filter("members > 1").select("bucket", "hub")
    member = work.save(rows.join(hubs, "bucket"), "buckets")
    ids = member.select("id").distinct()
    sets = work.save(docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(lambda it: _sets(it, size), "id long, set array<long>"), "sets")
    bits = reps.select(F.col("doc_id").alias("id"), "parity")
    tried = member.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = work.save(_verified(tried, sets, percent), "verified")
    group = graph.components(links, "a", "b")
    for best in (True, False):
        dealt = _blocks(member, group, bits).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        likely = dealt.mapInArrow(lambda it, best=best: _across(it, percent, best), "a long, b long").distinct()
        more = work.save(_verified(likely, sets, percent), "verified")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        group = graph.components(links, "a", "b")
    joined = signed.select("doc_id", "n_shingles", "set_a", "set_b", "text_key").join(classes, ["set_a", "set_b", "n_shingles"], "left").join(group.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    own = F.col("doc_id") == component
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), own.alias("kept"), F.coalesce(own, F.lit(False)).alias("first"), "text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: 4-word shingles over the whole of `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
