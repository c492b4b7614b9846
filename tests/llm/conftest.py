"""A table with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

CLASH = "score double, spans string, kept boolean, id long, host string, line long, x string, rank long, part long, whole long, cut long, component long, base long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def make(texts, ids=None, langs=None, sources=None):
    out = []
    for i, t in enumerate(texts):
        own = ids[i] if ids else i
        out.append((own, t, langs[i] if langs else ("en", "de", None)[i % 3], sources[i] if sources else ("src0", "src1", None)[i % 3], len(t) if t is not None else None, 0.5, "s", True, 7, "h", 1, "x", 2, 3, 4, 5, 6, 7))
    return out


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    rng = random.Random(5)
    long_ = words(rng, 40_000)
    base = words(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " \t\r\n\x0b", "one", "Éa öß中文 \U0001f600", base, base, " ".join(near), long_, "same line\nsame line\nother\n\nsame line", "x" * 50_000, "1 2 3 4 " * 3000, base.upper(), "ábc İ ΣΣ"]
    rows = make(texts)
    rows += [rows[5], rows[5], (None, *rows[5][1:]), (None, *rows[0][1:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(None, 1, 1), (3, None, None), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
