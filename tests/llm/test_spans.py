"""Mixing, PII, secrets, packing and the pipeline."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from provena.llm import op3_mixing, op4_pii, op6_toxicity, op7_secrets, op8_packing, op10_minhash

from .. import oracle
from .conftest import SCHEMA, make


def table(spark, name, sf=oracle.TINY):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def counted(rows):
    return collections.Counter(rows)


# --- mixing


@pytest.mark.parametrize("share,epochs", [((3, 5), 2), ((1, 10), 1), ((5, 2), 4), ((9, 1), 3)])
def test_mix_same_as_sql(spark, share, epochs):
    docs = table(spark, "documents").select("doc_id", "lang", "source", "text")
    got = op3_mixing.mix(docs, op3_mixing.WEIGHTS, f"sum(supply) * {share[0]} div {share[1]}", epochs, 3).select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "mix_tokens", "mix_key")
    assert oracle.difference(got, op3_mixing.sql(share=share, epochs=epochs, seed=3), oracle.connect(oracle.TINY)) == ""


def test_mix_awkward_same_as_sql(spark, awkward, nothing):
    c = oracle.connect(oracle.TINY)
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "lang", "source").collect()]
    c.execute("create table own (doc_id bigint, text varchar, lang varchar, source varchar)")
    c.executemany("insert into own values (?, ?, ?, ?)", rows)
    for share, epochs in (((3, 5), 2), ((1, 1), 1), ((20, 1), 3)):
        got = op3_mixing.mix(awkward, op3_mixing.WEIGHTS, f"sum(supply) * {share[0]} div {share[1]}", epochs, 7)
        assert got.columns[: len(awkward.columns)] == awkward.columns
        got = got.select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "mix_tokens", "mix_key")
        assert oracle.difference(got, op3_mixing.sql("own", share=share, epochs=epochs), c) == ""
    assert op3_mixing.mix(nothing, {}, "sum(supply)").count() == 0


def test_epochs_have_their_own_orders(spark):
    docs = spark.createDataFrame(make([f"text {i}" for i in range(200)], sources=["a"] * 200, langs=["en"] * 200), SCHEMA)
    rows = op3_mixing.mix(docs, {}, "sum(supply) * 5 div 2", 3, 1).collect()
    by = {e: [r.doc_id for r in sorted(rows, key=lambda r: r.mix_key) if r.mix_epoch == e] for e in (1, 2, 3)}
    assert len(by[1]) == len(by[2]) == 200 and by[1] != by[2] and 90 < len(by[3]) <= 100
    tokens = {r.doc_id: r.mix_tokens for r in rows}
    assert sum(tokens[i] for i in by[3]) <= sum(tokens.values()) // 2 < sum(tokens[i] for i in by[3]) + 4


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 5), ("b", "x", "4", 1000)], "mix_domain string, mix_lang string, mix_source string, supply long")
    got = {r.mix_source: r.budget for r in op3_mixing.budgets(leaves, "200", {}, 1).collect()}
    # a and b get 100 each; y can take 5, so x gets 95; source 1 can take 10, so source 2 gets 85
    assert got == {"1": 10, "2": 85, "3": 5, "4": 100}
    got = {r.mix_source: r.budget for r in op3_mixing.budgets(leaves, "600", {}, 1).collect()}
    assert got == {"1": 10, "2": 100, "3": 5, "4": 485}


# --- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    return sum(x if i % 2 == 0 else 2 * x // 10 + 2 * x % 10 for i, x in enumerate(digits(s)[::-1])) % 10 == 0


def pii(text):
    t, out = text or "", []
    for kind, pattern, ok in (("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(s)), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(t) if ok(m[0])]
    return out


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


TRICKY = [
    "a@b.c_d@e.f a@b a@b. x.y+z%q@h-1.co.uk.", "é1.2.3.4.5.6.7.8 0001.02.3.255 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111 1111  1111 1111",
    "+1 (988) 555-2485 42 +1 + 2 +12345678 +123456789012345 +1234567890123456", "@ + . 1", "tel 555-123-4567, ssn: 123-45-6789, on 2024-01-02, john (at) example (dot) org",
    "\U0001f600 me@x.org \U0001f600 10.0.0.1", "1 " * 9000, "a" * 60_000 + "@" + "b" * 100, "1." * 3000 + "1", "+" * 2000, "9" * 5000,
]


def test_pii_against_brute_force(spark, awkward, nothing):
    for docs in (table(spark, "documents"), awkward, spark.createDataFrame(make(TRICKY), SCHEMA)):
        want = {}
        for r in docs.collect():
            found = pii(r.text)
            want[r.doc_id] = (*(sum(k == x for k, _, _ in found) for x in op4_pii.BASE), sha(found)), found
        rows = op4_pii.find(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
            if r.doc_id is not None:
                assert base == want[r.doc_id][1]
            for s in r.spans:
                assert 0 <= s.score <= 1
                assert s.base or not any(b[1] < s.end and s.start < b[2] for b in base)
    assert op4_pii.find(nothing).count() == 0


def test_pii_adds_by_context(spark):
    texts = ["call tel 555-123-4567 today", "ssn: 123-45-6789.", "write john.doe (at) example (dot) org", "part 555-123-4567", "2024-01-02 10 20 30", "nothing here"]
    got = {r.doc_id: [s.kind for s in r.spans] for r in op4_pii.find(spark.createDataFrame(make(texts), SCHEMA)).collect()}
    assert got == {0: ["number"], 1: ["number"], 2: ["mailat"], 3: [], 4: [], 5: []}
    clean = {r.doc_id: r.text for r in op4_pii.redact(spark.createDataFrame(make([*texts, "\U0001f600 a@b.co and a@c.co", None]), SCHEMA)).collect()}
    assert clean[0] == "call tel [PII] today" and clean[6] == "\U0001f600 [PII] and [PII]" and clean[7] is None and clean[5] == texts[5]


@pytest.mark.parametrize("cases", [10, 1_000, 100_000])
def test_pii_found_at_every_size(spark, cases):
    """However many cases no rule confirms, each is found, and harmless numbers beside them are not."""
    planted = ["tel 555-123-{}", "ssn: 123-45-{}", "write john.doe (at) example{} (dot) org", "iban GB29NWBK60161331926818"]
    harmless = ["part 555-123-{}", "at 555-123-{} so", "2024-01-02 10 20 30"]
    rows = " union all ".join(f"select id * 7 + {k} as doc_id, replace('{t}', '{{}}', cast(1000 + id % 9000 as string)) as text from range({cases})" for k, t in enumerate(planted + harmless))
    docs = spark.sql(rows).union(spark.sql("select -id - 1, concat('me', id, '@x.org or +1 (988) 555-2485') from range(200)"))
    got = op4_pii.find(docs).selectExpr("pmod(doc_id, 7) as k", "doc_id >= 0 as own", "transform(spans, x -> x.kind) as kinds").filter("own").groupBy("k", "kinds").count().collect()
    assert {(r.k, tuple(r.kinds)): r["count"] for r in got} == {(k, t): cases for k, t in enumerate([("number",), ("number",), ("mailat",), ("account",), (), (), ()])}


@pytest.mark.parametrize("copies", [1, 400])
def test_pii_inside_failed_runs(spark, copies):
    """Numbers that stand side by side make runs too long for the base rules; bounded forms find them."""
    planted = {"+1 (269) 555-3296 4524132264652876 so": {"+1 (269) 555-3296", "4524132264652876"}, "x +1 (836) 555-9331 53.121.55.90 que": {"+1 (836) 555-9331"}, "+49 30 12 34 56 +1 (578) 555-6437 4918187128635271": {"+49 30 12 34 56", "+1 (578) 555-6437", "4918187128635271"}, "ref 4111 1111 1111 1111 2024 ok": set(), "no 8402 555 12": set()}
    texts = list(planted) * copies + [f"+1 (988) 555-{1000 + i} or 4111 1111 1111 1111" for i in range(60)]
    wrong = lost = right = 0
    for r in op4_pii.find(spark.createDataFrame(make(texts), SCHEMA)).collect():
        text = texts[r.doc_id]
        if text in planted:
            got = {text[s.start : s.end] for s in r.spans if s.kind != "ip"}
            want = planted[text]
            wrong, lost, right = wrong + len(got - want), lost + len(want - got), right + len(got & want)
    assert lost <= 0.1 * (lost + right) and wrong <= 0.02 * (wrong + right)


def test_pii_running_results(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 2, 3, 7, 50, 333)]
    df = spark.createDataFrame([(v,) for v in rows], "v array<bigint>")
    got = df.selectExpr("v", f"{op4_pii.running('v', op4_pii._add, '0L')} as sums", f"{op4_pii.running('v', op4_pii._max, '-1L')} as tops").collect()
    for r in got:
        assert r.sums == list(itertools.accumulate(r.v)) and r.tops == list(itertools.accumulate(r.v, max))


def test_pii_overlaps(spark):
    rng = random.Random(4)
    some = lambda n: [(s, s + rng.randint(1, 6)) for s in (rng.randrange(60) for _ in range(n))]
    rows = [(some(rng.randint(0, 12)), some(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(rows, "q array<struct<s:bigint,e:bigint>>, y array<struct<s:bigint,e:bigint>>")
    for r in df.selectExpr("q", "y", f"{op4_pii._touched('q', 'y')} as t").collect():
        want = collections.Counter((q.s, q.e, any(y.s < q.e and q.s < y.e for y in r.y)) for q in r.q)
        assert collections.Counter((t.q.s, t.q.e, t.hit) for t in r.t) == want


def test_pii_best_of_chains(spark):
    rng = random.Random(9)
    rows = [([(s, s + rng.randint(1, 8), "k", rng.randint(4, 9), rng.random()) for s in (rng.randrange(80) for _ in range(rng.randint(1, 14)))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "m array<struct<s:bigint,e:bigint,kind:string,gen:int,score:double>>")
    for r in df.selectExpr("m", f"{op4_pii._best('m')} as b").collect():
        chains = []
        for x in sorted(r.m, key=lambda x: x.s):
            if chains and x.s < max(y.e for y in chains[-1]):
                chains[-1].append(x)
            else:
                chains.append([x])
        want = sorted((x.s, x.e) for x in (max(c, key=lambda x: (x.score, -x.gen, -x.s)) for c in chains))
        assert sorted((x.s, x.e) for x in r.b) == want


def test_pii_in_linear_time(spark):
    """A quarter of a megabyte of addresses takes not much longer than an eighth."""
    took = []
    for size in (128, 256):
        big = spark.createDataFrame([(0, "10.0.0.1 " * (size * 1024 // 9)), (1, "+1 (988) 555-2485 " * (size * 1024 // 18)), (2, "tel 555-123-4567 " * (size * 1024 // 17))], "doc_id long, text string")
        began = time.time()
        assert op4_pii.candidates(big).selectExpr("sum(size(base)) + sum(size(more)) as n").first().n > size * 100
        took.append(time.time() - began)
    assert took[1] < 2.5 * took[0] + 2
    clean = op4_pii.redact(spark.createDataFrame(make(["é 10.0.0.1 " * 5000, "a@b.co " * 70 + "x"]), SCHEMA)).collect()
    assert {r.doc_id: r.text for r in clean} == {0: "é [PII] " * 5000, 1: "[PII] " * 70 + "x"}


# --- secrets

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def secrets(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], op7_secrets.KINDS.index(s[0])))


def crc_token(prefix, body):
    return prefix + body + op7_secrets._base62(zlib.crc32(body.encode()))


def test_secrets_against_brute_force(spark, awkward, nothing):
    tricky = ["PassWord = 'abcdefghijkl' é token:secret=aaaaaaaaaaaaaaaa", "api_key=short apikey:  \"0123456789abcdef0123\"", "AKIAABCDEFGHIJKLMN AKIAABCDEFGHIJKLM", "deadbeefdeadbee", "deadbeefdeadbeef", "0" * 40_000, "ſecret=abcdefghijkl paKssword=abcdefghijkl", "tokentoken=aaaaaaaaaaaa", "secret" * 2000]
    for docs in (table(spark, "documents"), awkward, spark.createDataFrame(make(tricky), SCHEMA)):
        want = counted((r.doc_id, tuple(secrets(r.text))) for r in docs.collect())
        got = counted((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in op7_secrets.BASE)) for r in op7_secrets.find(docs).collect())
        assert got == want
    assert op7_secrets.find(nothing).count() == 0


def test_checksums_decide(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = crc_token("ghp_", body), "ghp_" + body + "000000"
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    der = bytes([0x30, 0x03, 2, 1, 5])
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END PRIVATE KEY-----"
    texts = [f"x {good} y", f"x {bad} y", crc_token("npm_", body), f"{head}.{head}.abc", "eyJub3Rqc29u.eyJub3Rqc29u.abc", pem, pem.replace("MAMC", "MAMD").replace("AQU=", "AQUA")]
    docs = spark.createDataFrame(make(texts), SCHEMA)
    got = {r.doc_id: [s.kind for s in r.spans] for r in op7_secrets.find(docs).collect()}
    assert got == {0: ["github"], 1: [], 2: ["npm"], 3: ["jwt"], 4: [], 5: ["pem"], 6: []}
    clean = {r.doc_id: r.text for r in op7_secrets.redact(docs).collect()}
    assert clean[0] == "x [SECRET] y" and clean[1] == texts[1]


@pytest.mark.parametrize("part", ["eyJ", "eyJa.", "eyJa.eyJb", "eyJ.eyJ", "token", "token=", "token: ", "AKIA", "ghp_", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----a", "deadbeef", "secret=é"])
def test_secrets_in_linear_time(part):
    """A megabyte of one keyword."""
    raw = (part * (1_000_000 // len(part))).encode()
    began = time.process_time()
    op7_secrets.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert time.process_time() - began < 4


def test_jwt_starts_inside_runs():
    """Skipping starts of a failed run loses no token."""
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    text = f"eyJeyJx eyJ. xeyJ.eyJ {head}.{head}.ab eyJ{head} {head}.{head}.c"
    found = op7_secrets.spans(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    assert [text[s:e] for s, k, e in found if op7_secrets.KINDS[k] == "jwt"] == [f"{head}.{head}.ab", f"{head}.{head}.c"]


def test_jwt_after_keywords_in_other_case():
    """The prefilter ignores case; a hit in other case skips nothing."""
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    token, rng = f"{head}.{head}.sig", random.Random(6)
    texts = [f"keyjar_{token}", f"EYJ-{token}", f"eyjeYJEyJ_{token} EYJ {token}"]
    parts = ["eyj", "EYJ", "eYj", "eyJ", "keyjar", "_", "-", ".", " ", "x", token, f" {token}", head, "eyJ."]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]
    for text in texts:
        raw, want, at = text.encode(), [], 0
        while m := op7_secrets._JWT.search(raw, at):
            at = m.end()
            if op7_secrets._json_header(m):
                want.append(m.span())
        found = op7_secrets.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).get(0, [])
        assert [(s, e) for s, k, e in found if op7_secrets.KINDS[k] == "jwt"] == want, text


def test_redaction_keeps_the_rest(awkward):
    out = op7_secrets.redact(awkward)
    assert out.schema == awkward.schema and out.count() == awkward.count()


# --- packing


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op8_packing.tokenizer_file())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def hold(rows, ids, size=4096):
    """Pieces cover each document once, and sequences have no gaps."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for i, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and bytes(r.ids) == np.array(ids[i][at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids[i])
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert set(seq) == set(range(len(seq)))
    return len(seq)


def test_packing_whole_table(spark):
    docs = table(spark, "documents", oracle.SMALL)
    rows = docs.collect()
    ids = dict(zip([r.doc_id for r in rows], encode([r.text for r in rows]), strict=True))
    n = hold(op8_packing.pack(docs).collect(), ids)
    assert sum(map(len, ids.values())) > 0.99 * 4096 * n
    seq = op8_packing.sequences(op8_packing.pack(docs)).collect()
    assert len(seq) == n and all(r.padded_to in (4096, r.tokens) for r in seq)


def test_packing_odd_texts(spark, awkward, nothing):
    odd = ["Hello, World. it's 3.14... <|endoftext|> a_b", "don't.stop,now", "É.é,É", "é.x", "tab\tand space\x1cunit", "...,,,", "İstanbul.Σ", "a" * 3000, "1,2.3", " line", "x" * 20 + " " * 50, "٣٤.٥", "ⅷ.ª,º"]
    docs = spark.createDataFrame(make(odd), SCHEMA)
    hold(op8_packing.pack(docs).collect(), dict(enumerate(encode(odd))))
    rows = [r for r in awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    own = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
    hold(op8_packing.pack(own).collect(), dict(zip([r.doc_id for r in rows], encode([r.text for r in rows]), strict=True)))
    assert op8_packing.pack(awkward).filter("doc_id = 5").count() == 3
    assert op8_packing.pack(nothing).count() == 0


def test_chunks_have_the_tokenizer_ids():
    """Random strings of white space, control characters, marks and letters, chunk by chunk."""
    path = op8_packing.tokenizer_file()
    with open(path) as f:
        tokenizer, last, cache = op8_packing._encoder(path, f.read())
    rng = random.Random(3)
    alphabet = [*"abXYZ019.,;:!?'\"()-_ \n\t\x0b\x0c\r\x85\xa0\x1c\x1d\x1e\x1f\x00éßÉµªº²½", "don't", " . ", "\x1c."]
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))
        chunks = op8_packing._chunks(t)
        op8_packing._learn(tokenizer, last, cache, set(chunks) - set(cache))
        assert np.frombuffer(b"".join(cache[c] for c in chunks), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(0)
    for _ in range(30):
        size = int(rng.integers(4, 200))
        hist = {int(k): int(rng.integers(1, 500)) for k in rng.integers(1, size + 1, 20)}
        packs = op8_packing.patterns(hist, size)
        got = collections.Counter()
        for n, items in packs:
            assert sum(k * m for k, m in items) <= size and n > 0
            for k, m in items:
                got[k] += n * m
        assert got == hist
        assert len(packs) <= 2 * len(hist) + len(hist)


# --- pipeline


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input: what goes, what stays, and the columns."""
    import corpus_pipeline as p

    docs = table(spark, "documents", oracle.SMALL)
    columns = docs.columns
    kept = dict(p.STAGES)["toxicity"](spark, docs, oracle.SMALL)
    model = op6_toxicity.learn(docs, table(spark, "labels", oracle.SMALL))
    toxic = {r.doc_id for r in op6_toxicity.score(docs, model).filter("score >= 0.5").collect()}
    assert toxic and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic and kept.columns == columns

    from .test_near_dup import brute

    groups = brute([(r.doc_id, r.text) for r in kept.collect()], 5)
    one = dict(p.STAGES)["near_duplicates"](spark, kept, oracle.SMALL)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if c == i} and one.columns == columns

    safe = dict(p.STAGES)["secrets"](spark, one, oracle.SMALL)
    before = {r.doc_id: r.text for r in one.collect()}
    for r in safe.collect():
        found, text, at, out = secrets(before[r.doc_id]), before[r.doc_id], 0, []
        for _, s, e in found:
            if e > at:
                if s >= at:
                    out += [text[at:s], "[SECRET]"]
                at = e
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)
    assert safe.schema == docs.schema

    mixed = dict(p.STAGES)["mixing"](spark, safe, oracle.SMALL)
    c = oracle.connect(oracle.SMALL)
    c.register("own", safe.toArrow())
    want = c.execute(op3_mixing.sql("own", share=(1, 1), epochs=p.EPOCHS, seed=p.SEED)).fetchall()
    assert counted(r.doc_id for r in mixed.collect()) == counted(r[0] for r in want) and mixed.columns == columns

    packed = dict(p.STAGES)["packing"](spark, mixed, oracle.SMALL)
    rows = mixed.collect()
    assert packed.agg({"length": "sum"}).first()[0] == sum(map(len, encode([r.text for r in rows])))
    assert p.run(spark, oracle.SMALL).count() == packed.count()


def test_op10_default_takes_five_words():
    import inspect

    assert inspect.signature(op10_minhash.near_duplicates).parameters["size"].default == 5


def test_packing_of_null_ids_in_bounded_groups(spark):
    """A table without ids: pieces of one length are told apart by what they hold, so no group gathers them all."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "of", "and", "city", "river", "stone"], k=6)) for _ in range(3000)]
    from pyspark.sql import functions as F

    pieces = op8_packing.tokenize(spark.createDataFrame(make(texts, [None] * 3000), SCHEMA))
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids"))
    histogram = {r["length"]: r["n"] for r in narrow.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    assert max(histogram.values()) > 2000
    groups = [r["count"] for r in op8_packing._dealt(narrow, histogram, 50).groupBy("length", "pack_part").count().collect()]
    assert sum(groups) == 3000 and max(groups) < 150
    got = op8_packing.place(pieces).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(itertools.accumulate([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= 4096
    assert len(got) == 3000 and sum(r.length for r in got) > 0.95 * 4096 * (len(by) - 1)
