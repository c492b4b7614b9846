"""Contracts with rows that break them, binary formats, archives, manifests, optimizer, streams."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.functions import strategies
from provena.operators import contracts, decision, optimizer, parity, tensors
from provena.sources import archive, binary, bundle, shared


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_strict_alias(spark):
    df = spark.createDataFrame([("d", "a", "1"), ("d", "b", "1"), ("e", "a", "1"), ("e", "b", "2"), ("f", "a", None)], "field string, alias string, value string")
    assert values(contracts.strict_alias(df), "field", "agreed") == [("d", True), ("e", False)]


def test_lenient_alias_and_truthy(spark):
    df = spark.createDataFrame([({"a": "x", "b": "7"},), ({"b": "8", "a": "9"},), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(contracts.lenient_alias(F.col("m"), "a", "b")).collect()] == [7, 9, None]
    df = spark.createDataFrame([("", "b"), (None, ""), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(contracts.truthy(F.col("x"), F.col("y"))).collect()] == ["b", "", "a"]


def test_violations_count_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 9.0)], "k long, x double")
    assert values(contracts.violations(df, "r", F.col("k"), F.col("x") > 5, F.col("x")), "entity") == [("2",), ("3",)]


def test_key_difference_and_duplicates(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k long") for v in ([1, 2, 2], [2, 3]))
    assert values(contracts.key_difference(a, b, "k"), "k", "only_in") == [(1, "left"), (3, "right")]
    assert values(contracts.duplicates(a, "k"), "k", "n") == [(2, 2)]


@pytest.mark.parametrize("path,safe,below", [("a/b", True, True), ("", False, True), ("/a", False, False), ("../x", False, False), ("a/../../b", False, False), ("a/../b", False, True)])
def test_paths(spark, path, safe, below):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(contracts.safe_path(F.col("p")), contracts.below_root(F.col("p"))).first()) == (safe, below)


def test_slot_names(spark):
    df = spark.createDataFrame([("tok_embeddings.weight",), ("blocks.3.attn.q_proj.weight",), ("layers.11.mlp.gate.weight",), ("H.2.x",), ("final_norm.weight",), ("other",)], "n string")
    got = [tuple(r) for r in df.select(contracts.slot_kind(F.col("n")), contracts.layer_index(F.col("n"))).collect()]
    assert got == [("embedding", None), ("q_proj", 3), ("gate_proj", 11), (None, 2), ("final_norm", None), (None, None)]


def test_state_onto_slots(spark):
    names = spark.createDataFrame([(n,) for n in ("blocks.0.attn.q_proj.weight", "layers.0.attn.wk.bias", "h.1.attn.wq", "h.1.attn.query", "blocks.0.rotary", "blocks.0.attn.query.old")], "name string")
    slots = spark.createDataFrame([(s,) for s in ("blocks.0.attn.q_proj.weight", "blocks.0.attn.k_proj.weight", "blocks.1.attn.q_proj.weight", "blocks.1.attn.k_proj.weight")], "slot string")
    got = {(r.slot, r.name): r.status for r in contracts.normalize(names, slots).collect()}
    assert got == {
        ("blocks.0.attn.q_proj.weight",) * 2: "exact", ("blocks.0.attn.k_proj.weight", "layers.0.attn.wk.bias"): "classified", ("blocks.1.attn.q_proj.weight", None): "ambiguous",
        ("blocks.1.attn.k_proj.weight", None): "missing", **{(None, n): "unconsumed" for n in ("h.1.attn.wq", "h.1.attn.query", "blocks.0.rotary", "blocks.0.attn.query.old")},
    }


def test_finite_and_errors(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.5,)], "x double")
    assert [r[0] for r in df.select(parity.finite(F.col("x"))).collect()] == [False, False, False, True]
    got = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("b", 1, 1.001), ("b", 2, 2.0)], "candidate string, k int, got double")
    want = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, want double")
    v = {r.candidate: (r["pass"], r.n_nan) for r in parity.verdict(parity.compare(got, want, ["k"], ["candidate"])).collect()}
    assert v == {"a": (False, 1), "b": (True, 0)}


@pytest.mark.parametrize("ratio,verdict", [(1.4999, "not useful"), (1.5, "useful"), (1.9999, "useful"), (2.0, "canonical")])
def test_thresholds(spark, ratio, verdict):
    df = spark.createDataFrame([(True, ratio), (False, ratio)], "ok boolean, r double")
    assert [r[0] for r in df.select(decision.usefulness(F.col("ok"), F.col("r"))).collect()] == [verdict, "not useful"]


def test_choice_breaks_ties_by_priority(spark):
    df = spark.createDataFrame([("cpu", 1.0, 0), ("cl", 2.5, 1), ("vk", 2.5, 2)], "name string, ratio double, prio int")
    assert decision.choose(df, "name", "prio").first().chosen == "cl"
    assert spark.range(1).select(decision.ratio(F.lit(3.0), F.lit(0.0))).first()[0] == 0.0


def test_report_keeps_nulls(spark):
    df = spark.createDataFrame([("a", float("nan"), None)], "name string, thermal double, note string")
    assert decision.report(df, "thermal", "name", "note").first()[0] == '{"name":"a","note":null,"thermal":null}'


def test_optimizer_groups(spark):
    schema = "group_id int, beta1 double, beta2 double, eps double, names array<string>"
    usable = lambda rows: optimizer.group_semantics(spark.createDataFrame(rows, schema)).first().usable
    assert usable([(0, 0.9, 0.95, 1e-8, None)])
    assert usable([(0, 0.9, 0.95, 1e-8, ["a"]), (1, 0.9, 0.95, 1e-8, ["b"])])
    assert not usable([(0, 0.9, 0.95, 1e-8, None), (1, 0.9, 0.95, 1e-8, ["b"])])
    assert not usable([(0, 0.9, 0.95, 1e-8, ["a"]), (1, 0.9, 0.95, 1e-8, ["a"])])
    assert not usable([(0, 0.9, 0.95, 1e-8, ["a"]), (1, 0.8, 0.95, 1e-8, ["b"])])


def test_binary_round_trips(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, [0.25])], "key long, values array<double>")
    assert values(binary.decode(binary.encode(df, "<f4"), "<f4"), "key", "values") == [(1, [1.5, -2.0]), (2, [0.25])]
    df = spark.createDataFrame([(1, [1, -2, 2**31 - 1])], "key long, values array<int>")
    assert values(binary.decode(binary.encode(df, "<i4"), "<i4"), "key", "values") == [(1, [1, -2, 2**31 - 1])]
    pack = np.array([7, 513, 65535], "<u2").tobytes()
    row = spark.createDataFrame([(bytearray(pack),)], "c binary").select(binary.u16_range(F.col("c"), 1, 2), binary.u16_range(F.col("c"), 2, 2)).first()
    assert row[0] == [513, 65535] and row[1] is None
    assert spark.range(1).select(F.hex(binary.pack_u16(F.lit(513)))).first()[0] == "0102"


@pytest.mark.parametrize("shape,content", [([2], b"\0" * 4), ([0], b""), ([1], np.array([np.nan], "<f4").tobytes()), ([1], np.array([np.inf], "<f4").tobytes())])
def test_bad_tensors_fail(spark, shape, content):
    df = spark.createDataFrame([("t", shape, bytearray(content))], "key string, shape array<int>, content binary")
    with pytest.raises(Exception, match="tensor t"):
        binary.decode(df, "<f4").collect()


def test_archives(spark, tmp_path):
    entries = spark.createDataFrame([("a", "x/1", b"one"), ("a", "2", b""), ("b", "3", b"three")], "archive string, path string, content binary")
    archive.write(entries, f"file://{tmp_path}/z")
    assert values(archive.read(spark, f"file://{tmp_path}/z"), "path", "length") == [("2", 0), ("3", 5), ("x/1", 3)]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("dir/", "")
        z.writestr("../out", "x")
    (tmp_path / "bad.zip").write_bytes(bad.getvalue())
    with pytest.raises(Exception, match="leaves the archive"):
        archive.read(spark, f"file://{tmp_path}/bad.zip").collect()


def test_manifests_are_strict(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"a": 1, "b": "x"}\n')
    (tmp_path / "lost.json").write_text('{"a": 1}\n')
    (tmp_path / "kind.json").write_text('{"a": "one", "b": "x"}\n')
    assert values(bundle.read_manifest(spark, f"{tmp_path}/ok.json", "a long, b string"), "a", "b") == [(1, "x")]
    for name in ("lost", "kind"):
        with pytest.raises(Exception, match=r"field missing|MALFORMED|malformed"):
            bundle.read_manifest(spark, f"{tmp_path}/{name}.json", "a long, b string").collect()


def test_bundle_verification(spark):
    import hashlib

    sha = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("ok", 3, sha.upper()), ("size", 4, sha), ("sha", 3, "0"), ("gone", 3, sha)], "path string, length long, sha256 string")
    found = spark.createDataFrame([(p, 3, b"abc") for p in ("ok", "size", "sha", "extra")], "path string, length long, content binary")
    assert values(bundle.verify(manifest, found), "rule", "entity") == [("missing", "gone"), ("sha256", "sha"), ("size", "size")]
    assert bundle.manifest(found, "path").count() == 4


def test_atomic_write_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception):
        shared.write_atomic(spark.range(3).select(F.raise_error(F.lit("stop"))), f"file://{tmp_path}/t")
    assert list(tmp_path.iterdir()) == []


def test_strategies_are_isolated(spark):
    strategies.register("own", "good")(lambda s: s.range(3))
    strategies.register("own", "bad")(lambda s: s.range(3).select("nothing"))
    ran = strategies.run_all("own", spark)
    assert ran["good"][0].count() == 3 and ran["bad"][0] is None and ran["bad"][1]


def attention(x):
    out = np.zeros_like(x)
    for i in range(len(x)):
        s = x[: i + 1] @ x[i] / np.sqrt(x.shape[1])
        p = np.exp(s - s.max())
        out[i] = (p / p.sum()) @ x[: i + 1]
    return out


def test_attention_and_rope_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(9, 8))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "window long, pos long, vec array<double>")
    got = np.zeros_like(x)
    for r in tensors.attention(df, df, df, 8).collect():
        got[r.i, r.c] = r.y
    assert np.allclose(got, attention(x))
    for layout in ("half_split", "interleaved"):
        y = np.array([r[0] for r in df.orderBy("pos").select(tensors.rope(F.col("vec"), F.col("pos"), 8, layout=layout)).collect()])
        i = np.arange(8)
        power, turned = ((i % 4) * 2 / 8, np.concatenate([-x[:, 4:], x[:, :4]], 1)) if layout == "half_split" else ((i - i % 2) / 8, np.stack([-x[:, 1::2], x[:, ::2]], 2).reshape(9, 8))
        angle = np.arange(9)[:, None] * 10000.0**-power
        assert np.allclose(y, x * np.cos(angle) + turned * np.sin(angle))


def test_gradients_by_differences(spark):
    """RMS norm and softmax cross-entropy gradients against central differences."""
    rng = np.random.default_rng(1)
    x, dy = rng.normal(size=(2, 3, 5))
    rows = [(i, j, float(x[i, j]), float(dy[i, j])) for i in range(3) for j in range(5)]
    df = spark.createDataFrame(rows, "r long, c long, x double, dy double")
    f = lambda z: float((dy * z / np.sqrt((z * z).mean(1, keepdims=True) + 1e-5)).sum())
    g = lambda z: float(np.mean([np.log(np.exp(v).sum()) - v[k] for k, v in enumerate(z)]))
    ce = df.withColumn("target", F.col("r"))
    for fun, got in ((f, tensors.rms_norm_backward(df)), (g, tensors.softmax_gradient(ce, "target", F.lit(3)))):
        for r in got.collect():
            d = np.zeros_like(x)
            d[r.r, r.c] = 1e-5
            assert abs((fun(x + d) - fun(x - d)) / 2e-5 - r[2]) < 1e-6


def test_reshape_and_linear(spark):
    x = np.arange(12.0).reshape(3, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    moved = {(r.r, r.c): r.x for r in tensors.reshape(tensors.to_long(df, "k", "v"), 4, 6).collect()}
    assert all(moved[i, j] == x.reshape(2, 6)[i, j] for i in range(2) for j in range(6))
    w = np.ones((2, 4))
    assert {r.r: r.vec for r in tensors.linear_arrow(df, "k", "v", w).collect()} == {i: (x @ w.T)[i].tolist() for i in range(3)}


def test_sharing_plans(spark):
    """Filters and columns reach the scan, and sums are partial before the shuffle."""
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 45").groupBy("l_returnflag").agg(F.sum("l_tax"))
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "partial_sum" in plan
    assert "l_comment" not in plan
