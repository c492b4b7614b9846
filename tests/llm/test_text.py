"""Quality, languages, toxicity, rules: whole tables, held-out accuracy, awkward rows."""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import numpy as np

from provena.llm import op1_quality, op2_langid, op5_lines, op6_toxicity
from provena.llm.bytes_ import Words, buffers, windows

from .. import oracle
from .conftest import SCHEMA, make

SPACE = r"[^\x20\x09-\x0D]+"


def table(spark, name, sf=oracle.SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_words_of_buffers():
    import pyarrow as pa

    texts = ["a b", None, "", " cé  d", "b"]
    buf, off = buffers(pa.array(["skip", *texts]).slice(1))
    w = Words(buf, off)
    assert w.counts.tolist() == [2, 0, 0, 2, 1]
    assert [bytes(buf[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)] == ["a", "b", "cé", " d", "b"]
    h = w.hashes()
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    assert len(windows(h, w.first, 2)[0]) == 2


def test_quality_held_out(spark):
    got = op1_quality.query(spark, oracle.SMALL)
    own = got.join(table(spark, "labels"), "doc_id").collect()
    held = [r for r in own if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in own)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert got.count() == table(spark, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in own)


def test_forest_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = op1_quality.grow(x[:1000], y[:1000])
    assert ((f.probability(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    assert op1_quality.grow(np.zeros((0, 3)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]
    assert (op1_quality.grow(x, np.ones(2000)).probability(x) > 0.9).all()


def test_quality_awkward(spark, awkward, nothing, labels, no_labels):
    described = op1_quality.describe(awkward)
    for known in (labels, no_labels):
        rows = op1_quality.score(described, op1_quality.learn(described, known)).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    empty = op1_quality.describe(nothing)
    assert op1_quality.score(empty, op1_quality.learn(empty, labels)).count() == 0


def slow_statistics(text):
    t = text or ""
    w = re.findall(SPACE, t)
    size = [len(x.encode()) for x in w]
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    n, chars, n_lines = max(len(w), 1), max(sum(map(len, w)), 1), max(len(lines), 1)
    many = lambda chars_: sum(c in chars_ for c in t)
    upper = lambda x: sum("A" <= c <= "Z" for c in x)

    def inside(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    return [
        np.log1p(len(w)), sum(map(len, w)) / n, many("#*$%&|<>") / chars, upper(t) / chars, many("0123456789") / chars, many("!?") / chars, many("|") / n, len(set(w)) / n, max(collections.Counter(w).values(), default=0) / n,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, (len(lines) - len(set(lines))) / n_lines, inside(8) / n, inside(3) / n, len(w) / n_lines, sum(s <= 2 for s in size) / n, sum(s >= 12 for s in size) / n,
        sum(2 * upper(x) > s and s > 1 for x, s in zip(w, size, strict=True)) / n, many(".,;:") / n,
    ]


def test_statistics_against_brute_force(spark, awkward):
    for docs in (awkward, table(spark, "documents", oracle.TINY)):
        texts = [r.text for r in docs.select("text").collect()]
        for text, r in zip(texts, op1_quality.describe(docs).collect(), strict=True):
            assert np.allclose(r.x, slow_statistics(text), rtol=1e-12, atol=1e-12), (text or "")[:80]


def test_forest_against_a_walk():
    """The flat arrays give what a walk down each tree gives."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    f = op1_quality.grow(x, (x[:, 0] * x[:, 1] > 0.1).astype(float), trees=7, depth=3)
    for row, got in zip(x, f.margin(x), strict=True):
        want = f.bias
        for feature, cut, leaf in zip(f.feature, f.cut, f.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            want += leaf[at - len(feature)]
        assert abs(want - got) < 1e-12


def slow_mixture(like):
    """Proportions of one document from its words' likelihoods, step by step."""
    n, k = len(like), len(like[0])

    def em(pi):
        for _ in range(op2_langid.ROUNDS):
            total = [0.0] * k
            for row in like:
                s = sum(p * x for p, x in zip(pi, row, strict=True))
                for i in range(k):
                    total[i] += pi[i] * row[i] / s
            pi = [t / n for t in total]
        return pi, sum(np.log(sum(p * x for p, x in zip(pi, row, strict=True))) for row in like)

    full, _ = em([1 / k] * k)
    order = sorted(range(k), key=lambda i: -full[i])
    best = [float(i == order[0]) for i in range(k)]
    chosen = sum(np.log(row[order[0]]) for row in like)
    for size in range(2, k + 1):
        pi, got = em([1 / size if i in order[:size] else 0.0 for i in range(k)])
        if got - 0.5 * np.log(n + 1.0) * (size - 1) > chosen:
            best, chosen = pi, got - 0.5 * np.log(n + 1.0) * (size - 1)
    return best


def test_mixtures_against_brute_force():
    rng = np.random.default_rng(8)
    docs = []
    for kind in range(40):
        own = rng.choice(4, size=rng.integers(1, 4), replace=False)
        lang = rng.choice(own, size=rng.integers(1, 80))
        docs.append(np.exp(np.where(np.arange(4) == lang[:, None], 0.0, -rng.exponential(1 + kind % 5, (len(lang), 4)))))
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = op2_langid.infer(np.concatenate(docs), first)
    for d, g in zip(docs, got, strict=True):
        assert np.allclose(g, slow_mixture(d.tolist()), atol=1e-9)


def test_language_held_out(spark):
    rows = op2_langid.query(spark, oracle.SMALL).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == table(spark, "documents").count()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures(spark):
    """Two languages in one text come out with their shares; the set is not larger than needed."""
    docs = table(spark, "documents")
    model = op2_langid.learn(docs)
    by = {}
    for r in docs.filter("n_chars > 2000").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text)
    en, fr = (by[k].split()[:150] for k in ("en", "fr"))
    mixed = spark.createDataFrame(make([" ".join(en + fr), " ".join(en), "12 34 --", None, "— —"]), SCHEMA)
    rows = {r.doc_id: r for r in op2_langid.predict(mixed, model).collect()}
    share = dict(zip(model.langs, rows[0].proportions, strict=True))
    assert 0.3 < share["en"] < 0.7 and 0.3 < share["fr"] < 0.7
    assert rows[1].lang_pred == "en" and rows[1].score > 0.99
    assert [(rows[i].lang_pred, rows[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3


def test_language_awkward(awkward, nothing):
    model = op2_langid.learn(awkward)
    rows = op2_langid.predict(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 11)} == {"und"}
    assert op2_langid.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in op2_langid.predict(awkward, op2_langid.learn(nothing)).collect()} == {"und"}


def base_rules(text):
    t = text or ""
    w = re.findall(SPACE, t)
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {i for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    n = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(inside))
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_against_brute_force(spark, awkward, nothing):
    for docs in (table(spark, "documents"), awkward):
        want = collections.Counter((r.doc_id, *base_rules(r.text)) for r in docs.collect())
        got = op5_lines.judge(docs).collect()
        assert collections.Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert op5_lines.judge(nothing).count() == 0


def brute_depleted(rows):
    """Line frequencies over distinct texts of each host and of all, as documented."""
    norm = lambda line: " ".join(re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))
    texts = {(r.source, r.text) for r in rows if re.search(SPACE, r.text or "")}
    often, common = collections.Counter(), collections.Counter()
    for h, t in texts:
        own = {x for x in map(norm, t.split("\n")) if x.count(" ") + 1 >= op5_lines.LINE_WORDS}
        often.update((h, x) for x in own)
        common.update(own)
    out = {}
    for r in rows:
        n = len(re.findall(SPACE, r.text or ""))
        lines = [norm(x) for x in (r.text or "").split("\n")]
        gone = [len(x.split(" ")) for x in lines if often[r.source, x] > op5_lines.HOST_LIMIT or common[x] > op5_lines.ALL_LIMIT]
        left = n - sum(gone)
        out[r.doc_id] = bool(gone) and (left < op5_lines.WORDS_LEFT or left < op5_lines.SHARE_LEFT * n)
    return out


def test_lines_across_documents(spark):
    footer = "This common   footer stands below every page of the host"
    body = [" ".join(f"w{i}{j}" for j in range(30)) for i in range(40)]
    texts = [f"{b}\n{footer.upper() if i % 2 else footer}" for i, b in enumerate(body)] + [footer + " x\n" + footer, "\n".join([footer] * 4), body[0] + "\nonly here"]
    docs = spark.createDataFrame(make(texts, sources=["a"] * 40 + ["a", "a", None]), SCHEMA)
    got = {r.doc_id: r for r in op5_lines.judge(docs).collect()}
    assert all(got[i].n_removed_lines == 1 and got[i].kept and got[i].words_left == 30 for i in range(40))
    assert not got[41].kept and got[42].kept and got[42].n_removed_lines == 0
    clean = {r.doc_id: r.text for r in op5_lines.strip(docs).collect()}
    assert clean[3] == body[3] and clean[41] == "" and clean[42] == texts[42]
    for d in (docs, table(spark, "documents")):
        want = brute_depleted(d.collect())
        assert all((not r.kept) == (r.base_failed or want[r.doc_id]) for r in op5_lines.judge(d).collect())


def test_boilerplate_in_small_and_large_hosts(spark):
    """A planted line is removed whatever share of a host's documents holds it; rare and short ones stay."""
    hosts = {"all": (60, 60), "tenth": (600, 60), "hundredth": (6000, 60), "below": (300, 15)}
    texts, sources, planted = [], [], []
    for h, (size, n) in hosts.items():
        for i in range(size):
            own = i < n
            text = " ".join(f"{h}{i}w{j}" for j in range(25)) + "\nthe end"
            texts.append(text + (f"\nread more of {'this' if h != 'below' else 'that'} site" if own else ""))
            sources.append(h)
            planted.append(own and h != "below")
    docs = spark.createDataFrame(make(texts, sources=sources), SCHEMA)
    got = {r.doc_id: r.n_removed_lines for r in op5_lines.judge(docs).collect()}
    assert all(got[i] == int(p) for i, p in enumerate(planted))
    # In the corpus: six documents in each of twenty hosts are above the limit of all.
    texts = [" ".join(f"q{i}w{j}" for j in range(25)) + "\nprinted by one press" for i in range(120)]
    spread = spark.createDataFrame(make(texts, sources=[f"h{i % 20}" for i in range(120)]), SCHEMA)
    assert all(r.n_removed_lines == 1 and r.kept for r in op5_lines.judge(spread).collect())
    # Copies count only where that is asked for; then their own lines deplete them.
    copies = spark.createDataFrame(make(["\n".join(" ".join(f"l{k}w{j}" for j in range(12)) for k in range(4))] * 40, sources=["one"] * 40), SCHEMA)
    assert all(r.kept for r in op5_lines.judge(copies).collect())
    assert not any(r.kept for r in op5_lines.judge(copies, count_copies=True).collect())


def test_toxicity_held_out(spark):
    rows = op6_toxicity.query(spark, oracle.SMALL).join(table(spark, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9
    assert not any(r.predicted and not r.toxic for r in held)


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_automaton_is_levenshtein():
    terms = ["abc", "abcd", "dabca", "abcdabcd", "dcbadcba"]
    auto = op6_toxicity.Automaton(terms)
    rng = np.random.default_rng(4)
    tried = {"".join(p) for n in range(1, 5) for p in itertools.product("abd", repeat=n)}
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                k = rng.integers(0, len(w) + 1)
                w[k : k + rng.integers(0, 2)] = "abcdz"[rng.integers(0, 5)] * rng.integers(0, 2)
            tried.add("".join(w))
    for w in tried - {""}:
        want = min((e for t in terms if (e := levenshtein(w, t)) <= op6_toxicity.limit(t)), default=9)
        assert auto.distance(w) == want, w


def slow_features(text, terms):
    """Every word against every term, and every hit's window, one by one."""
    near = lambda w: min((d for t in terms if (d := levenshtein(w, t)) <= op6_toxicity.limit(t)), default=9)
    words, open_ = [], False
    for t in re.findall(r"[^\W_]+|[\"“”«»„\n]|!!", text.lower()):
        if t == "!!":
            if words:
                words[-1][2] = True
        elif t[0].isalnum():
            words.append([t, open_, False, near(t)])
        else:
            open_ = False if t == "\n" else not open_ if t == '"' else t in "“«„"
    hits = [i for i, w in enumerate(words) if w[3] <= 2]
    if not hits:
        return None
    total, best, mentions = [0.0, 0.0, 0.0], 0.0, 0
    for i in hits:
        around = words[max(0, i - op6_toxicity.WINDOW) : i + op6_toxicity.WINDOW + 1]
        others = sum(abs(i - j) <= op6_toxicity.WINDOW for j in hits) - 1
        mention = words[i][1] or any(w[0] in op6_toxicity._QUOTING for w in words[max(0, i - 3) : i])
        strong = any(w[2] or w[0] in op6_toxicity._ADDRESS for w in around)
        value = (0.25 if mention else 1) * (1 + 0.25 * min(others, 4)) * (1.2 if strong else 1)
        total[words[i][3]] += value
        mentions += mention
        best = max(best, value if words[i][3] == 0 else 0)
    return [float(total[0] > 0.5), *np.log1p(total), best, mentions / len(hits), np.log1p(len(hits)) / np.log1p(len(words) + 1)]


def test_windows_against_brute_force(monkeypatch):
    monkeypatch.setattr(op6_toxicity, "_KEPT", 40)  # caches run over and begin again
    rng = np.random.default_rng(11)
    terms = ["worthless", "idiot", "scum", "ab", "vermin"]
    auto = op6_toxicity.Automaton(terms)
    pool = [*terms, "wortless", "idiots", "idot", "scumm", "vrmn", "abc", "said", "wrote", "you", "plain", "word", "über", "x9"]
    marks = ["", "", "", "", '"', "“", "”", "\n", "!!", "!", ","]
    for _ in range(400):
        text = " ".join(str(rng.choice(marks)) + str(rng.choice(pool)) + str(rng.choice(marks)) for _ in range(rng.integers(1, 50)))
        got, want = op6_toxicity.features(text, auto), slow_features(text, terms)
        assert (got is None) == (want is None)
        assert got is None or np.allclose(got, want, atol=1e-12), text


def test_quotation_and_misspelling():
    model = op6_toxicity.Model(["worthless", "idiot"], [0.0] * 7, 0.0)
    auto = op6_toxicity.Automaton(model.terms)
    value = lambda t: op6_toxicity.features(t, auto)
    assert value("a clean text") is None and value(None) is None and value("") is None
    assert value("you worthless idiot")[1] > value('he wrote "worthless" here')[1]
    assert value("you wrthles person")[1] == 0 and value("you wrthles person")[3] > 0


def test_toxicity_awkward(awkward, nothing, labels, no_labels):
    for known in (labels, no_labels):
        model = op6_toxicity.learn(awkward, known)
        rows = op6_toxicity.score(awkward, model).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        kept = op6_toxicity.screen(awkward, model)
        assert kept.schema == awkward.schema
    assert op6_toxicity.score(nothing, op6_toxicity.learn(nothing, labels)).count() == 0


def test_toxic_copies_keep_their_terms(spark):
    """Thousands of exact or near copies of one toxic text neither hide its terms nor teach its other words."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("bcdfghklmn"), 6)) for _ in range(3000)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    clean = [" ".join(prose(60)) for _ in range(600)]
    toxic = []
    for _ in range(60):
        w = prose(60)
        w[20] = w[40] = "zworthless"
        toxic.append(" ".join(w))
    hot = prose(60)
    hot[30], hot[10] = "zworthless", "rareinnocent"
    near = [" ".join([*hot[:58], f"e{i}", f"f{i}"]) for i in range(1500)]
    for copies in ([" ".join(hot)] * 1500, near):
        texts = clean + toxic + copies
        labelled = spark.createDataFrame([(i, 0, int(i >= len(clean))) for i in range(len(texts))], "doc_id long, quality int, toxic int")
        docs = spark.createDataFrame(make(texts), SCHEMA)
        model = op6_toxicity.learn(docs, labelled)
        assert model.terms == ["zworthless"]
        rows = {r.doc_id: r.score for r in op6_toxicity.score(docs, model).collect()}
        assert all((s >= 0.5) == (i >= len(clean)) for i, s in rows.items())


def test_large_lexicon(spark):
    """Every significant term is learned, however many there are."""
    rng = np.random.default_rng(7)
    word = lambda letters: "".join(rng.choice(list(letters), 7))
    plain, terms = [word("bcdfghklmn") for _ in range(1000)], sorted({word("aeiopqrstu") for _ in range(500)})
    clean = [" ".join(rng.choice(plain, 100)) for _ in range(240)]
    toxic = [" ".join(x for t in rng.choice(terms, 200, replace=False) for x in (rng.choice(plain), t)) for _ in range(80)]
    labelled = spark.createDataFrame([(i, 0, int(i >= 240)) for i in range(320)], "doc_id long, quality int, toxic int")
    model = op6_toxicity.learn(spark.createDataFrame(make(clean + toxic), SCHEMA), labelled)
    assert len(terms) > 450 and set(model.terms) >= set(terms)
