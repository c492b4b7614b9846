"""Archives by ranges of entries, and checkpoints read without running them."""

from __future__ import annotations

import hashlib
import io
import os
import pickle
import random
import sys
import threading
import time
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.sources import archive, checkpoint


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Two archives with small and large entries, stored and deflated."""
    folder, rng = tmp_path_factory.mktemp("zips"), random.Random(1)
    want = {}
    for k in range(2):
        with zipfile.ZipFile(folder / f"a{k}.zip", "w") as z:
            for i in range(40):
                data = rng.randbytes(rng.choice([0, 1, 999, 1000, 1001, 25_000])) if i % 2 else b"text " * rng.randrange(9000)
                name = f"{'x' if i % 3 else 'y'}/{k}-{i}"
                z.writestr(name, data, zipfile.ZIP_STORED if i % 4 < 2 else zipfile.ZIP_DEFLATED)
                want[name] = data
            z.writestr("folder/", "")
    return folder, want


def joined(df):
    parts = {}
    for r in df.collect():
        parts.setdefault(r.path, []).append((r.start, bytes(r.content), r.length))
    out = {}
    for path, own in parts.items():
        own.sort()
        assert [s for s, _, _ in own] == np.cumsum([0, *(len(c) for _, c, _ in own)])[:-1].tolist()
        out[path] = b"".join(c for _, c, _ in own)
        assert all(n == len(out[path]) for *_, n in own)
    return out


@pytest.mark.parametrize(("task", "chunk"), [(10_000, 1000), (1 << 20, 1 << 16)])
def test_entries_in_chunks(spark, mixed, task, chunk):
    folder, want = mixed
    df = archive.chunks(spark, f"file://{folder}", task, chunk)
    assert joined(df) == want and (df.rdd.getNumPartitions() > 20) == (task == 10_000)
    assert {r.path: bytes(r.content) for r in archive.read(spark, str(folder)).collect()} == want


def test_conditions_reach_the_reader(spark, mixed):
    folder, want = mixed
    one = archive.chunks(spark, str(folder), 10_000, 1000).filter("path = 'y/1-3'")
    assert joined(one) == {"y/1-3": want["y/1-3"]} and one.rdd.getNumPartitions() <= 3
    some = archive.chunks(spark, str(folder)).filter(F.col("path").startswith("y/") & F.col("path").isin("y/0-0", "x/0-1", "y/0-9") & (F.col("length") >= 0))
    assert joined(some) == {k: want[k] for k in ("y/0-0", "y/0-9")}
    assert archive.chunks(spark, str(folder)).filter("path = 'none'").count() == 0
    # the entries that are left out are not even opened: a damaged one does not matter
    bad = folder / "sub"
    bad.mkdir(exist_ok=True)
    raw = bytearray((folder / "a0.zip").read_bytes())
    raw[raw.find(b"x/0-1") + 200] ^= 255
    (bad / "b.zip").write_bytes(raw)
    assert archive.chunks(spark, str(bad)).filter("path = 'y/0-0'").count() > 0
    with pytest.raises(Exception, match="damaged"):
        archive.chunks(spark, str(bad)).collect()


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x"])
def test_entries_outside_fail(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("fine", b"1")
        z.writestr(name, b"2")
    with pytest.raises(Exception, match="leaves the archive"):
        archive.chunks(spark, str(tmp_path)).filter("path = 'fine'").collect()


def test_large_archive_in_little_memory(spark, tmp_path):
    """Three gigabytes of entries, stored and deflated, by several tasks; no Python worker holds 200 MB more than it had."""
    import psutil

    block = random.Random(2).randbytes(1 << 20)
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        for k, (kind, n) in enumerate([(zipfile.ZIP_STORED, 1200), (zipfile.ZIP_DEFLATED, 1000), (zipfile.ZIP_STORED, 600), (zipfile.ZIP_DEFLATED, 250)]):
            info = zipfile.ZipInfo(f"e{k}")
            info.compress_type = kind
            with z.open(info, "w", force_zip64=True) as f:
                for _ in range(n):
                    f.write(block if kind == zipfile.ZIP_STORED else bytes(1 << 20))
    most, stop = {}, threading.Event()

    def watch():
        own = psutil.Process()
        while not stop.is_set():
            for p in own.children(recursive=True):
                try:
                    if "pyspark.daemon" in " ".join(p.cmdline()):
                        rss = p.memory_full_info().uss
                        low, high = most.get(p.pid, (rss, rss))
                        most[p.pid] = (min(low, rss), max(high, rss))
                except psutil.Error:
                    pass
            time.sleep(0.2)

    t = threading.Thread(target=watch)
    t.start()
    try:
        df = archive.chunks(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 30
        got = {r.path: (r.n, r.size) for r in df.groupBy("path").agg(F.sum(F.octet_length("content")).alias("n"), F.max("length").alias("size")).collect()}
    finally:
        stop.set()
        t.join()
    mb = 1 << 20
    assert got == {"e0": (1200 * mb, 1200 * mb), "e1": (1000 * mb, 1000 * mb), "e2": (600 * mb, 600 * mb), "e3": (250 * mb, 250 * mb)}
    assert most and max(high - low for low, high in most.values()) < 200e6
    os.unlink(tmp_path / "large.zip")


# --- checkpoints


@pytest.fixture
def torch_like(monkeypatch):
    """Modules of the names that a description holds, for pickling only."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    for k in checkpoint.STORAGES:
        setattr(torch, k, type(k, (), {"__module__": "torch"}))

    def _rebuild_tensor_v2(*args):
        raise AssertionError("a description is never run")

    for f in (_rebuild_tensor_v2,):
        f.__module__, f.__qualname__ = "torch._utils", f.__name__
        setattr(utils, f.__name__, f)
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    return torch, utils


class T:
    def __init__(self, key, kind, storage, offset, shape, stride):
        self.key, self.kind, self.storage, self.offset, self.shape, self.stride = key, kind, storage, offset, shape, stride


def save(path, obj, storages, torch, utils, protocol=2):
    import collections

    class S:
        def __init__(self, t):
            self.t = t

    class P(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", getattr(torch, x.t.kind), x.t.key, "cpu", x.t.storage) if isinstance(x, S) else None

        def reducer_override(self, x):
            return (utils._rebuild_tensor_v2, (S(x), x.offset, x.shape, x.stride, False, collections.OrderedDict())) if isinstance(x, T) else NotImplemented

    out = io.BytesIO()
    P(out, protocol).dump(obj)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.pkl", out.getvalue())
        for k, v in storages.items():
            z.writestr(f"archive/data/{k}", v)


@pytest.mark.parametrize("protocol", [2, 4])
def test_checkpoint_row_for_row(spark, tmp_path, torch_like, protocol):
    import collections

    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 4)).astype("<f4"), rng.integers(0, 99, 24).astype("<i8"), rng.normal(size=5).astype("<f8")
    state = collections.OrderedDict(
        [
            ("w", T("0", "FloatStorage", 12, 0, (3, 4), (4, 1))),
            ("w_t", T("0", "FloatStorage", 12, 0, (4, 3), (1, 4))),  # another view of the same storage
            ("row", T("0", "FloatStorage", 12, 4, (4,), (1,))),
            ("ids", T("1", "LongStorage", 24, 0, (2, 3, 4), (12, 4, 1))),
            ("every_other", T("1", "LongStorage", 24, 1, (6,), (2,))),
            ("scalar", T("2", "DoubleStorage", 5, 3, (), ())),
            ("none", T("2", "DoubleStorage", 5, 0, (0, 7), (7, 1))),
        ]
    )
    whole = {"model": state, "optimizer": {"state": {0: {"step": 3, "m": T("2", "DoubleStorage", 5, 0, (5,), (1,))}}, "groups": [{"lr": 1e-3, "betas": (0.9, 0.95), "amsgrad": False}]}, "step": 2**40, "name": "run é", "nothing": None}
    save(tmp_path / "x.pt", whole, {"0": a.tobytes(), "1": b.tobytes(), "2": c.tobytes()}, *torch_like, protocol)
    want = {
        "model.w": ([3, 4], "f32", a.tobytes()),
        "model.w_t": ([4, 3], "f32", a.T.tobytes()),
        "model.row": ([4], "f32", a[1].tobytes()),
        "model.ids": ([2, 3, 4], "i64", b.tobytes()),
        "model.every_other": ([6], "i64", b[1:12:2].tobytes()),
        "model.scalar": ([], "f64", c[3:4].tobytes()),
        "model.none": ([0, 7], "f64", b""),
        "optimizer.state.0.m": ([5], "f64", c.tobytes()),
    }
    for task in (1 << 20, 50):
        df = checkpoint.tensors(spark, str(tmp_path), task)
        assert {r.name: (r["shape"], r.kind, bytes(r.content)) for r in df.collect()} == want
        assert all(r.length == len(r.content) for r in df.collect())
        assert (df.rdd.getNumPartitions() > 3) == (task == 50)
    plain = {r.name: r.value for r in checkpoint.values(spark, str(tmp_path)).collect()}
    assert plain == {"optimizer.state.0.step": "3", "optimizer.groups.0.lr": "0.001", "optimizer.groups.0.betas.0": "0.9", "optimizer.groups.0.betas.1": "0.95", "optimizer.groups.0.amsgrad": "false", "step": str(2**40), "name": "run é", "nothing": None}


@pytest.mark.parametrize("value", [os.system, print, hashlib.sha256, types.SimpleNamespace(a=1), {1, 2}, b"bytes", 1j])
def test_any_other_name_is_refused(spark, tmp_path, torch_like, value):
    ran = []
    if callable(value):
        value = type("Call", (), {"__reduce__": lambda self, f=value: (f, ("touch /tmp/never",))})()
    save(tmp_path / "x.pt", {"w": T("0", "FloatStorage", 1, 0, (1,), (1,)), "bad": value}, {"0": bytes(4)}, *torch_like)
    for f in (checkpoint.tensors, checkpoint.values):
        with pytest.raises(Exception, match="refused|no dictionary"):
            f(spark, str(tmp_path)).collect()
    assert not ran and not os.path.exists("/tmp/never")


@pytest.mark.parametrize(("storage", "offset", "shape", "stride", "held"), [(4, 1, (4,), (1,), 16), (4, 0, (2, 2), (3, 1), 16), (4, 0, (4,), (1,), 12), (4, 0, (2,), (-1,), 16)])
def test_tensors_outside_their_storage_are_refused(spark, tmp_path, torch_like, storage, offset, shape, stride, held):
    save(tmp_path / "x.pt", {"w": T("0", "FloatStorage", storage, offset, shape, stride)}, {"0": bytes(held)}, *torch_like)
    with pytest.raises(Exception, match="outside its storage|missing or short"):
        checkpoint.tensors(spark, str(tmp_path)).collect()


def test_damaged_descriptions_fail(torch_like):
    good = checkpoint.pickled([("a", [2, 3]), ("b", [])], {"step": 1, "x": {"y": 1.5, "z": None, "big": 2**40}})
    got = dict(checkpoint.leaves(checkpoint.Description().run(good)))
    assert got["model.a"].shape == (2, 3) and got["x.big"] == 2**40 and got["x.z"] is None and got["x.y"] == 1.5
    rng = random.Random(0)
    for _ in range(400):  # never anything but an error or plain data
        raw = bytearray(good)
        for _ in range(rng.randint(1, 3)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            for _, x in checkpoint.leaves(checkpoint.Description().run(bytes(raw))):
                assert x is None or isinstance(x, (checkpoint.Tensor, checkpoint.Name, checkpoint.Storage, int, float, str, bool))
        except (ValueError, IndexError, KeyError, TypeError, UnicodeDecodeError, AttributeError):
            pass
