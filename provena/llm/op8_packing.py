"""Packing: shortest-pack-first over the length histogram.

1. Tokenise (one pass). A text's white-space-separated chunks are encoded once for each distinct chunk
   and looked up in a bounded cache, because this tokenizer lower-cases and never looks across white
   space or between letters and marks; a document is the joined ids with the end id, cut into pieces of
   at most `size` ids. The tokenizer itself encodes every chunk.
2. The histogram of piece lengths has at most `size` rows, so it is the one thing the driver sees.
   Lengths are placed longest first; each goes to the packs with the most room (the shortest packs),
   all equal packs at once, so only pattern counts change. Patterns number at most two for each length.
3. Pieces are ranked inside their length and joined to patterns by rank. A length may hold any share of
   the pieces, so it is dealt into salted groups of bounded size whose offsets are summed first.

Defined results: null text is empty, an empty text is the end id alone; null ids and repeated rows are
packed like others; an empty table gives no rows; extra columns stay out of the pieces; sequences end
at their last piece, and `padded_to` says to which length a trainer pads them (`size`, or the sequence's
own length where that is a power of two).
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import work
from .bytes_ import column, slices

SIZE = 4096
END = 2
#: Chunks that a worker remembers (about 150 bytes each).
_CACHE = 300_000
#: The white space of Latin-1 as the tokenizer sees it (U+001C to U+001F are no part of it).
_SPACE = r"\x09-\x0D\x20\x85\xA0"
#: Two marks side by side, which the tokenizer takes as one.
_MARKS = re.compile(rf"[^{_SPACE}\w][^{_SPACE}\w]|_")
_loaded: dict = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(key: str, text: str):
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        vocabulary = json.loads(text)["model"]["vocab"]
        last = np.zeros(max(vocabulary.values(), default=0) + 100, bool)
        last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        _loaded[key] = (Tokenizer.from_str(text), last, {"": b""})
    return _loaded[key]


def _chunks(text: str) -> list[str]:
    """White-space-separated chunks, in lower case and with single stops and commas apart where that
    cannot change the ids."""
    if _LATIN(text) and not _MARKS.search(text):
        text = text.lower().replace(".", " . ").replace(",", " , ")
    return text.replace("\n", " ").split(" ")


def _LATIN(text: str) -> bool:  # noqa: N802
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _learn(tokenizer, last: np.ndarray, cache: dict[str, bytes], new: set[str]) -> None:
    """Ids of new chunks. Words of letters only are encoded as one text, each ending at its first
    end-of-word token; other chunks are encoded alone."""
    words = [w for w in new if w.isalpha()]
    for lo in range(0, len(words), 20_000):
        own = words[lo : lo + 20_000]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) == len(own) and ends[-1] == len(ids):
            raw, cut = ids.tobytes(), [0, *(ends * 4).tolist()]
            cache.update(zip(own, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
        else:  # a word without an end of its own
            cache.update((w, _one(tokenizer, w)) for w in own)
    other = [w for w in new if not w.isalpha()]
    for lo in range(0, len(other), 20_000):
        for w, e in zip(other[lo : lo + 20_000], tokenizer.encode_batch_fast(other[lo : lo + 20_000], add_special_tokens=False), strict=True):
            cache[w] = np.array(e.ids, "<u4").tobytes()


def _tokenized(batches: Iterator[pa.RecordBatch], key: str, text, size: int, end: int) -> Iterator[pa.RecordBatch]:
    tokenizer, last, cache = _encoder(key, text.value)
    stop = np.array([end], "<u4").tobytes()
    for batch, _, _ in slices(batches):
        row, start, length, total, ids = [], [], [], [], []
        split = [_chunks(t or "") for t in column(batch, "text").to_pylist()]
        if new := set().union(*split).difference(cache):
            if len(cache) + len(new) > _CACHE:
                cache.clear()
                new = set().union(*split)
            _learn(tokenizer, last, cache, new)
        for i, chunks in enumerate(split):
            got = b"".join([cache[c] for c in chunks]) + stop
            n = len(got) // 4
            for s in range(0, n, size):
                row.append(i)
                start.append(s)
                length.append(min(size, n - s))
                total.append(n)
                ids.append(got[4 * s : 4 * (s + size)])
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "start", "length", "doc_tokens", "ids"],
        )


def _one(tokenizer, chunk: str) -> bytes:
    return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


def tokenize(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_file()
    with open(path) as f:
        held = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few megabytes
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _tokenized(it, path, held, size, end), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, pieces of it in each pack)]) that hold the whole histogram."""
    heap: list[tuple[int, int]] = []  # (-room, index), the shortest packs first
    packs: list[tuple[int, list[tuple[int, int]]]] = []

    def put(count: int, items: list[tuple[int, int]], room: int) -> None:
        heapq.heappush(heap, (-room, len(packs)))
        packs.append((count, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, i = heapq.heappop(heap)
                room, (count, items) = -room, packs[i]
                level = -heap[0][0] if heap else 0  # fill down to the next shortest packs
                each = min(max(1, -(-(room - level) // length)), room // length, max(1, left // count))
                used = min(count, left // each)
                put(used, [*items, (length, each)], room - each * length)
                if used < count:
                    put(count - used, items, room)
                left -= used * each
            else:
                each = min(size // length, left)
                used = left // each
                put(used, [(length, each)], size - each * length)
                left -= used * each
    return [packs[i] for _, i in heap]


def slots(packs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Columns: length, first rank, first sequence, pieces a pack, offset; sorted by length and rank."""
    out, rank, first = [], {}, 0
    for count, items in packs:
        offset = 0
        for length, each in items:
            lo = rank.get(length, 0)
            out.append((length, lo, first, each, offset))
            rank[length] = lo + count * each
            offset += length * each
        first += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], table_, key_shift: int = 44) -> Iterator[pa.RecordBatch]:
    t = table_.value
    keys = (t[:, 0] << key_shift) + t[:, 1]
    for batch in batches:
        length, rank = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "pack_rank"))
        s = t[np.searchsorted(keys, (length << key_shift) + rank, "right") - 1]
        own = rank - s[:, 1]
        names = [n for n in batch.schema.names if n != "pack_rank"]
        yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(s[:, 2] + own // s[:, 3]), pa.array(s[:, 4] + own % s[:, 3] * length)], [*names, "sequence_id", "offset"])


def _dealt(pieces: DataFrame, histogram: dict[int, int], group: int) -> DataFrame:
    """Pieces with `pack_part`, so that a length's pieces come in groups of about `group`, and `pack_content`: pieces of
    a null or repeated id are told apart by what they hold."""
    content = F.col("ids_crc32") if "ids_crc32" in pieces.columns else F.lit(0).cast("long")
    deal = pieces.sparkSession.createDataFrame([(k, -(-n // group)) for k, n in histogram.items()], "length long, pack_parts long")
    dealt = pieces.join(F.broadcast(deal), "length").withColumn("pack_part", F.pmod(F.xxhash64("doc_id", "start", content), "pack_parts"))
    return dealt.withColumn("pack_content", content).drop("pack_parts")


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns beside doc_id, start and length stay)."""
    spark = pieces.sparkSession
    ship(spark)
    if "ids" in pieces.columns:  # ids stay behind: places are found for narrow rows and joined
        whole = work.save(pieces.withColumn("pack_row", F.monotonically_increasing_id()), "pieces")
        placed = place(whole.select("pack_row", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32")), size)
        return whole.join(placed.select("pack_row", "sequence_id", "offset"), "pack_row").drop("pack_row")
    pieces = work.save(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    group = max(1, -(-sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    dealt = _dealt(pieces, histogram, group)
    base = dealt.groupBy("length", "pack_part").agg(F.count("*").alias("n")).selectExpr("length", "pack_part", "sum(n) over (partition by length order by pack_part) - n as pack_base")
    columns = pieces.columns
    ranked = dealt.join(base, ["length", "pack_part"]).selectExpr(*(f"`{c}`" for c in columns), "pack_base + row_number() over (partition by length, pack_part order by doc_id, start, pack_content) - 1 as pack_rank")
    held = spark.sparkContext.broadcast(slots(patterns(histogram, size)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(lambda it: _placed(it, held), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """All pieces with their ids and places."""
    return place(tokenize(docs, path, size, end), size)


def sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each sequence: its ids in order, its tokens and the length a trainer pads it to."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("pieces"), F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return own.withColumn("padded_to", F.when(power, F.col("tokens")).otherwise(size))


def digest(docs: DataFrame) -> DataFrame:
    pieces = tokenize(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return place(pieces)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, packed into sequences of 4096 ids."""
    return digest(table(spark, sf_dir, "documents"))
