from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import graph, op9_metric_join, op10_minhash

from .. import oracle
from .conftest import SCHEMA, make, words


def shingle_set(text, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def brute(rows, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in rows}
    u, ids = Union(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k", [4, 5])
def test_whole_table(spark, k):
    docs = spark.read.parquet(f"{oracle.TINY}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k)
    got = op10_minhash.near_duplicates(docs, size=k)
    assert result(got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_chains_and_blocks(spark, monkeypatch):
    """Chains of edits, whose ends are not alike, and several groups in one bucket, in tiny blocks."""
    monkeypatch.setattr(op10_minhash, "BLOCK", 4)
    rng, rows = random.Random(1), []
    for g in range(3):
        w = words(rng, 90).split()
        for step in range(25):
            rows.append(" ".join(w))
            for _ in range(1 + g):
                w[rng.randrange(len(w))] = f"edit{g}{step}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(make(rows), SCHEMA)
    assert result(op10_minhash.near_duplicates(docs, size=4)) == brute(list(enumerate(rows)), 4)


def test_threshold_is_exact(spark):
    """Sets of 9 and 10 with 8 or 9 in common, around 80 percent."""
    w = [f"w{i}" for i in range(40)]
    rows = [" ".join(w[:12]), " ".join(w[:13]), " ".join(w[:14]), " ".join(w[1:12]), " ".join(w[2:12]), " ".join([*w[:10], "z"])]
    docs = spark.createDataFrame(make(rows), SCHEMA)
    assert result(op10_minhash.near_duplicates(docs, size=4)) == brute(list(enumerate(rows)), 4)


def test_awkward_rows(awkward, nothing):
    got = op10_minhash.near_duplicates(awkward, size=4)
    assert got.count() == awkward.count()
    own = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert own[0].n_shingles == own[1].n_shingles == own[2].n_shingles == 0
    assert own[5].component_id == own[6].component_id == own[7].component_id == own[12].component_id == 5
    assert own[3].n_shingles == 1 and own[3].component_id == 3
    assert op10_minhash.near_duplicates(nothing).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for n, shared in ((2000, 1600), (300, 200), (40, 30), (3, 2)):
        a, b = pool[:n], pool[n - shared : 2 * n - shared]
        sig = op10_minhash.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 200)
        assert abs((sig[0] == sig[1]).mean() - shared / (2 * n - shared)) < 0.13
        assert (sig != np.uint64(2**64 - 1)).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    u = Union({x for p in links for x in p if x is not None} | {None})
    for a, b in links:
        if a is not None and b is not None:
            u.join(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5), "a", "b").collect()}
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell long, far double, own int, id long")


def brute_vectors(rows, cosine=0.95):
    good = {}
    for r in rows:
        v = r[1]
        if v and r[0] is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[r[0]] = x / np.linalg.norm(x)
    u, n = Union({r[0] for r in rows}), dict.fromkeys((r[0] for r in rows), 0)
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                n[a] += 1
                u.join(a, b)
    return {i: (n[i], u.find(i)) for i in n}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(op9_metric_join, "BLOCK", 16)
    monkeypatch.setattr(op9_metric_join, "CHUNK", 5)
    monkeypatch.setattr(op9_metric_join, "PAIRS", 64)
    monkeypatch.setattr(op9_metric_join, "SLICES", 2)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * 0.12).tolist() for _ in range(30)]
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], None, [], [0.0] * 8, [float("nan")] * 8, [float("inf"), *[1.0] * 7], [None, *[1.0] * 7], [1e-30] * 8, [1e30] * 8, [1.0, 2.0], [1.0, 2.0], [1.0]]
    full = [(i, v, 0, 1, 0.5, 1, 3) for i, v in enumerate(rows)]
    got = op9_metric_join.range_join(vectors(spark, full)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(full)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert op9_metric_join.range_join(vectors(spark, [])).count() == 0


def test_vectors_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{oracle.SMALL}/embeddings.parquet").collect()]
    got = op9_metric_join.query(spark, oracle.SMALL).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows)


def test_vectors_without_ids(spark):
    x = [1.0, 0.0, 2.0]
    df = spark.createDataFrame([(1, x), (2, x), (None, x), (None, None), (3, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in op9_metric_join.range_join(df).collect()), key=repr)
    assert got == [(0, 0, None, None), (0, 0, None, None), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def linked(spark, x, cosine=0.95):
    """Share of all pairs that the search compares; its links must be those of brute force."""
    from provena.llm import work

    n = len(x)
    classes = work.save(spark.createDataFrame([(v.tolist(), i, 1) for i, v in enumerate(x)], "vector array<double>, id long, copies long"), "classes")
    found = op9_metric_join.search(classes, cosine)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for lo in range(0, n, 1000):
        near = unit[lo : lo + 1000] @ unit.T >= cosine
        want |= {lo + i: int(k) - 1 for i, k in enumerate(near.sum(1)) if k > 1}
    got = {r.id: r.n for r in found.filter("id is not null").groupBy("id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == want
    return found.filter("id is null").agg({"n": "sum"}).first()[0] / n**2


@pytest.mark.parametrize(("dimensions", "clusters", "most"), [(4, 0, 0.1), (32, 200, 0.1), (64, 0, 1.0)])
def test_pivots_leave_few_pairs_where_vectors_have_structure(spark, dimensions, clusters, most):
    rng = np.random.default_rng(dimensions)
    x = rng.normal(size=(6000, dimensions))
    if clusters:
        x = 0.12 * x / dimensions**0.5 + rng.normal(size=(clusters, dimensions))[rng.integers(0, clusters, 6000)] / dimensions**0.5
    share = linked(spark, x, 0.999 if dimensions == 4 else 0.95)
    print(f"{dimensions} dimensions, {clusters} clusters: {share:.3f} of all pairs compared")
    assert share <= most


def test_parity_bound_holds_and_tells_long_texts_apart():
    """The bound never exceeds the true difference, between bitmaps of different sizes too, and leaves no pair of
    unrelated long sets."""
    rng = np.random.default_rng(3)

    def bitmap(values):
        bits = int(op10_minhash.parity_bits(np.array([len(values)]))[0])
        odd = np.zeros(bits, np.uint8)
        np.add.at(odd, (values & np.uint64(bits - 1)).astype(np.int64), np.uint8(1))
        return np.packbits(odd & 1).view(np.uint64)[None, :]

    for n, m, shared in ((6000, 6000, 0), (20_000, 19_000, 0), (6000, 7000, 5900), (1000, 1100, 990), (1024, 1025, 1000), (200_000, 200_000, 0)):
        pool = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
        a, b = pool[:n], pool[n - shared :]
        far = int(op10_minhash.differing_bits(bitmap(a), bitmap(b))[0, 0])
        assert far <= n + m - 2 * shared
        if not shared:
            assert 180 * far > 20 * (n + m)


def test_long_texts_in_one_bucket(spark, monkeypatch):
    """Unrelated long texts that share a bucket are not sent to verification; near copies still link."""
    rng = random.Random(11)
    words_ = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [words_(n) for n in (3000, 3000, 6000, 6000, 9000)]
    near = [*texts[2][:-10], *words_(10)]
    rows = make([" ".join(t) for t in [*texts, near, texts[0]]])

    d = spark.createDataFrame(rows, SCHEMA)
    signed = op10_minhash.signatures(d, 5).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "parity")
    block = signed.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "n", F.col("id").alias("component"), F.lit(0).alias("side"), "parity")
    pairs = block.coalesce(1).mapInArrow(lambda it: op10_minhash._across(it, 80, False), "a long, b long").collect()
    assert {tuple(p) for p in pairs} == {(2, 5), (0, 6)}
    got = {r.doc_id: r.component_id for r in op10_minhash.near_duplicates(d).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 0}
