"""Operators that return the rows of their input: clashing names, null ids, repeated rows."""

from __future__ import annotations

import collections

from provena.llm import op3_mixing, op4_pii, op5_lines, op6_toxicity, op7_secrets

from .conftest import SCHEMA, make

CLASH = "mix_domain string, mix_row long, mix_key long, mix_tokens long, kept long, found string, spans string, gone string, own_md5 string, host string, label long"


def docs(spark, texts, sources=None):
    rows = [(i if i != 1 else None, t, "en", sources[i] if sources else "src0", None if t is None else len(t), "d", 1, 2, 3, 4, "f", "s", "g", "m", "h", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:2]], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def rest(df):
    return collections.Counter(tuple(v for k, v in r.asDict().items() if k != "text") for r in df.collect())


TEXTS = ["mail a@b.co here", "write x@y.org now", None, "", "nothing at all", "password = 'abcdefghijkl' and more"]


def test_mix_keeps_clashing_columns(spark):
    d = docs(spark, TEXTS)
    out = op3_mixing.mix(d, {}, "sum(supply)", 1)
    assert out.columns == [*d.columns, "mix_epoch"]
    assert rest(out.drop("mix_epoch")) == rest(d)


def test_redaction_of_null_and_repeated_ids(spark):
    d = docs(spark, TEXTS)
    out = op4_pii.redact(d)
    assert out.columns == d.columns and rest(out) == rest(d)
    want = {"mail [PII] here": 2, "write [PII] now": 2, None: 1, "": 1, "nothing at all": 1, TEXTS[5]: 1}
    assert collections.Counter(r.text for r in out.collect()) == want
    out = op7_secrets.redact(d)
    assert out.schema == d.schema and rest(out) == rest(d)


def test_lines_of_null_and_repeated_ids(spark):
    footer = "this line stands below every page"
    texts = [f"body number {i} of the pages\n{footer}" for i in range(30)] + [None, ""]
    d = docs(spark, texts, ["a"] * 32)
    out = op5_lines.strip(d)
    assert out.columns == d.columns and rest(out) == rest(d)
    assert {r.text for r in out.collect()} == {f"body number {i} of the pages" for i in range(30)} | {None, ""}


def test_screen_keeps_columns(spark):
    d = docs(spark, TEXTS)
    out = op6_toxicity.screen(d, op6_toxicity.Model())
    assert out.schema == d.schema and rest(out) == rest(d)


def test_pipeline_keeps_one_of_repeated_rows(spark, awkward):
    import corpus_pipeline as p

    stage = dict(p.STAGES)["near_duplicates"]
    ids = collections.Counter(r.doc_id for r in stage(spark, awkward, "").collect())
    assert ids[5] == 1 and ids[None] == 2 and 6 not in ids and 7 not in ids
    one = stage(spark, spark.createDataFrame(make(["only one of these"] * 3, [4, 4, 4]), SCHEMA), "")
    assert [r.doc_id for r in one.collect()] == [4]


def test_unique_text_of_a_repeated_id_stays(spark):
    """Rows of one id with different texts are different documents, in the operator and in the pipeline."""
    import corpus_pipeline as p
    from provena.llm import op10_minhash

    a = [f"word{i}" for i in range(60)]
    near, unique = " ".join([*a[:59], "other"]), " ".join(f"single{i}" for i in range(40))
    twin = unique + " more"
    rows = [(3, " ".join(a)), (7, near), (7, unique), (9, twin), (7, twin), (None, unique), (11, None), (11, "alone here")]
    docs = spark.createDataFrame(make([t for _, t in rows], [i for i, _ in rows]), SCHEMA)
    got = collections.Counter((r.doc_id, r.component_id, r.first, r.kept) for r in op10_minhash.near_duplicates(docs).collect())
    group = sum(n for (i, c, _, _), n in got.items() if c == 7)
    assert got[3, 3, True, True] == 1 and got[7, 3, False, False] == 1 and group == 3 and got[9, 7, False, False] == 1
    assert sum(n for (i, c, first, _), n in got.items() if c == 7 and first) == 1 and got[11, 11, True, True] == 2
    kept = collections.Counter((r.doc_id, r.text) for r in dict(p.STAGES)["near_duplicates"](spark, docs, "").collect())
    assert kept[3, rows[0][1]] == 1 and kept[7, near] == 0 and kept[9, twin] == 0 and kept[None, unique] == 1
    assert kept[7, unique] + kept[7, twin] == 1 and kept[11, None] == kept[11, "alone here"] == 1


def test_empty_table_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
