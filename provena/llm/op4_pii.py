"""PII: candidate gradient boosting, in DataFrame operations only.

High-recall generators (regular expressions in the JVM) propose overlapping spans. Those of the four base
kinds that pass the kind's own check are base spans and always stay. The added kinds are scored: `number`
(any digit groups), `dial` and `longdial` (bounded international numbers, which also stand inside runs too
long for the base rule), `pan` (bounded card forms), `mailat` (spelled-out mail addresses) and `account`.
Each added candidate has small integer features of its format (generator, digits, groups, separators, shape)
and its context (words before it, letters beside it). No check is a feature.

Labels come from two sources, each of which weighs the same for a generator, so neither the size of a table
nor its number of unlabelled cases changes the result:

* weak labels of the corpus, by checks that the features do not hold: a candidate on a base phone or card
  (seen without its `+`), or with right check digits, is personal data; a card form with a wrong check digit
  or a candidate after a harmless word is not; all others have no label;
* examples, made by the rules of `EXAMPLES` from forms and sentences, whose labels are known.

As features are small integers, all labelled candidates are one contingency table whose size is bounded by
their product; Spark counts it, boosted trees are grown on three quarters of it (by a hash of the text), and
come back as nested CASE expressions. Each generator's threshold is calibrated on the other quarter: going
down from the best score, it stops where precision would fall below `PRECISION`.

Spans stay arrays in their document's row, so nothing is shuffled but the table's counts. Running sums over
an array go by parts of the square root of its length, so a text of many spans needs no array copied for each.

Defined results: null and empty texts have no spans; base spans always stay; added spans never overlap base
spans, `number` never lies in a failed run with a `+`, and of added spans that overlap in a chain the best
stays; repeated rows and null ids are handled like others; an empty table gives no rows; extra columns are
ignored by `find` and kept, whatever their names, by `redact`.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import work

BASE = ("email", "ip", "card", "phone")
#: The method's own kinds.
ADDED = ("number", "dial", "longdial", "pan", "mailat", "account")
KINDS = (*BASE, *ADDED)
#: Least precision of what a threshold lets through, and of each score it lets through.
PRECISION, LEVEL = 0.98, 0.9
TREES, DEPTH, RATE, RIDGE = 40, 4, 0.3, 0.5
#: What the weak labels, and the examples, of one generator weigh together.
WEIGHT = 60.0
#: One document in so many is kept out of the trees, for the thresholds.
HELD = 4

# Fixed patterns: of the contract, without backtracking (runs are entered at their start only), and of
# the method's own generators.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])[(]?[0-9]{2,}+(?:[\x20().-]{1,2}[0-9]{2,}+){1,5}+(?![0-9A-Za-z])",
    "dial": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{1,4}+\)?(?:[\x20.-][0-9]{2,4}+){2}+(?![0-9A-Za-z])",
    "longdial": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{1,4}+\)?(?:[\x20.-][0-9]{2,4}+){3,4}+(?![0-9A-Za-z])",
    "pan": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}+|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])",
    "mailat": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z]{2,24}+){1,4}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}+){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
}
_GUARD = {
    "email": "contains(text, '@')",
    "ip": r"text rlike r'[0-9]\.[0-9]+\.[0-9]+\.[0-9]'",
    "card": r"text rlike r'[0-9](?:[\x20-]?[0-9]){12}'",
    "phone": "contains(text, '+')",
    "number": r"text rlike r'[0-9]{2}[\x20().-]{1,2}[0-9]{2}'",
    "dial": "contains(text, '+')",
    "longdial": "contains(text, '+')",
    "pan": r"text rlike r'[0-9]{13}|[0-9]{4}[\x20-][0-9]{4,6}[\x20-][0-9]{4}'",
    "mailat": r"text rlike r'[(\[{]at[)\]}]'",
    "account": r"text rlike r'[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}'",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Fixed context words, by category; the last is of harmless numbers.
_CONTEXT = (
    r"(?i)(?:tel|phone|call|mobile|cell|fax|whatsapp|sms)[^0-9]{0,12}$",
    r"(?i)(?:mail|contact|write to)[^0-9]{0,12}$",
    r"(?i)(?:card|visa|mastercard|credit|debit)[^0-9]{0,12}$",
    r"(?i)(?:ssn|social security|passport|iban|account|tax id)[^0-9]{0,12}$",
    r"(?i)(?:isbn|issn|version|page|order|part|section|rfc)[^0-9]{0,12}$",
)
HARMLESS = len(_CONTEXT)
# Fixed shapes: identity number, telephone number, card number, dates, the end of a mail address.
_SHAPE = (
    r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$",
    r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$",
    r"^[0-9]{4}(?:[ -][0-9]{4}){3}$",
    r"^(?:[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-][0-9]{4})$",
    r"[a-z0-9)\]}](?:[.]|[\x20]?[(\[{]dot[)\]}][\x20]?)[a-z]{2,6}$",
)
FEATURES = ("gen", "digits", "groups", "seps", "shape", "context", "beside")

_PHONES = ("555-123-4567", "(555) 123-4567", "555.123.4567", "555 123 4567", "030 1234567", "0171 234 5678", "01 23 45 67 89", "020 7946 0958")
_CALLS = ("tel {} today", "phone: {}", "call {} now", "my mobile is {}.", "fax {}", "please call me, {}", "whatsapp {} or write", "sms to {}")
_PLAIN = ("{}", "at {} so", "then {} and more", "value {}, others", "we saw {} there", "(see {})")
_WORDS = ("isbn {}", "version {}", "page {}", "order {} shipped", "part {}", "section {} of it", "rfc {}")
#: Rules of the examples: forms, sentences, and whether the forms are personal data there.
EXAMPLES = (
    (_PHONES, _CALLS, 1),
    (("123-45-6789", "123 45 6789", "078-05-1120"), ("ssn: {}.", "social security {}", "tax id {}", "passport no {}"), 1),
    (("4111 1111 1111 1112", "5500-0000-0000-0005", "3782 822463 10006", "4111111111111112", "5105 1051 0510 5101"), ("card {}", "visa {}", "credit card: {}", "my debit card {}"), 1),
    (("+1 (555) 123-4567", "+1 555-123-4567", "+44 20 7946 0958", "+49 30 12 34 56", "+33 1 23 45 67 89", "+1.555.123.4567"), (*_CALLS, *_PLAIN), 1),
    (("john.doe (at) example (dot) org", "jane(at)site.com", "a.b [at] mail [dot] firm [dot] net", "info{at}firm.de", "mary.jane (at) uni.edu", "user42 (at) mail8 (dot) example (dot) com", "x1y(at)site9.com", "j7 [at] host12 [dot] org"), (*_PLAIN, "mail {}", "contact: {}", "write to {}"), 1),
    (("GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NL91ABNA0417164300"), (*_PLAIN, "iban {}", "account {}", "my account no {}"), 1),
    ((*_PHONES, "123-45-6789", "4111 1111 1111 1112", "5500-0000-0000-0005", "10 20 30", "12 13 14 15 16", "2024-01-02 10 20 30", "1000 2000", "12.34", "12-14-16", "2024-01-02", "02.01.2024", "99 100 101 102", "10.20.30"), _PLAIN, 0),
    ((*_PHONES, "123-45-6789", "4111 1111 1111 1112", "4111111111111112", "978 13 16 148410", "10.20.30", "2024-01-02", "+1 555-123-4567", "AB12 CDEF 3456", "XY99ABCD1234EFGH"), _WORDS, 0),
    (("meet (at) noon. Then", "open [at] nine. Bring", "arrive (at) Rome. Leave", "look {at} this. Now"), _PLAIN, 0),
    (("AB12CDEF3456", "XY99 ABCD 1234", "QR20 2024 0101"), _PLAIN, 0),
)
_NONE = "cast(array() as array<struct<s:bigint,e:bigint,x:string,b:string,a:string>>)"
_bare = "replace(x.x, ' ', '')"
_names = itertools.count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """SQL of `body` of `value`, which is computed once."""
    v = f"v{next(_names)}"
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def running(values: str, op: Callable[[str, str], str], zero: str) -> str:
    """SQL of inclusive running results of an associative `op`: parts of about the square root of the length
    are summed up first, so no element is copied more often than that."""

    def grown(part: str, start: str) -> str:
        return f"aggregate({part}, array({start}), (a, x) -> concat(a, array({op('element_at(a, -1)', 'x')})))"

    def cut(v: str) -> str:
        return _let(f"greatest(1, cast(sqrt(size({v})) as int))", lambda w: f"transform(sequence(0, (size({v}) - 1) div {w}), i -> slice({v}, cast(i * {w} + 1 as int), {w}))")

    def joined(parts: str) -> str:
        starts = grown(f"transform({parts}, p -> aggregate(p, {zero}, (a, x) -> {op('a', 'x')}))", zero)
        return _let(starts, lambda s: f"flatten(transform({parts}, (p, k) -> slice({grown('p', f'{s}[k]')}, 2, size(p))))")

    return _let(values, lambda v: f"if(size({v}) > 0, {_let(cut(v), joined)}, {v})")


def _add(a: str, b: str) -> str:
    return f"{a} + {b}"


def _max(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _spans(kind: str) -> str:
    """Leftmost non-overlapping matches (s, e, x) with their places in code points, and up to 32 code
    points before and one behind (b, a), back to the match before. Pieces between matches and matches
    alternate, so places are running sums of lengths."""
    pattern = _PATTERN[kind]
    pieces = f"zip_with(split(text, r'{pattern}', -1), regexp_extract_all(text, r'{pattern}', 0), (g, h) -> struct(g as gap, h as hit))"
    long = "coalesce(cast(length({}) as bigint), 0L)"

    def placed(p: str) -> str:
        ends = running(f"transform({p}, y -> {long.format('y.gap')} + {long.format('y.hit')})", _add, "0L")
        one = lambda e: f"struct({e}[i] - {long.format('y.hit')} as s, {e}[i] as e, y.hit as x, right(y.gap, 32) as b, left(get({p}, i + 1).gap, 1) as a)"
        return f"filter({_let(ends, lambda e: f'transform({p}, (y, i) -> {one(e)})')}, y -> y.x is not null)"

    return f"if({_GUARD[kind]}, {_let(pieces, placed)}, {_NONE})"


def _touched(queries: str, spans: str) -> str:
    """`queries` (structs with s and e) as structs (q, hit): does one of `spans` overlap it? One sweep in
    the order of places: a span overlaps if it starts before the query's end and reaches beyond its start."""

    def sweep(q: str, y: str) -> str:
        asked = f"transform({q}, x -> struct(x.e as at, 0 as t, x.s as v, x as q))"
        given = f"transform({y}, x -> struct(x.s as at, 1 as t, x.e as v, if(false, get({q}, 0), null) as q))"
        return _let(f"sort_array(concat({asked}, {given}))", reached)

    def reached(events: str) -> str:
        far = running(f"transform({events}, x -> if(x.t = 1, x.v, -1L))", _max, "-1L")
        return f"transform(filter(zip_with({events}, {far}, (x, r) -> struct(x.t as t, x.q as q, r > x.v as hit)), z -> z.t = 0), z -> struct(z.q as q, z.hit as hit))"

    return _let(queries, lambda q: _let(spans, lambda y: sweep(q, y)))


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    each = f"transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 0, cast(c as int), (2 * cast(c as int)) % 10 + (2 * cast(c as int)) div 10))"
    return f"aggregate({each}, 0, (a, x) -> cast(a + x as int)) % 10 = 0"


def _mod97(x: str) -> str:
    """The check digits of an account number are right."""
    return f"aggregate(split(concat(substr({x}, 5), substr({x}, 1, 4)), ''), 0, (a, c) -> if(c rlike '[0-9]', (a * 10 + coalesce(try_cast(c as int), 0)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"


def _valid(kind: str, x: str) -> str:
    """The base rule's own check."""
    n = f"length({_digits(x)})"
    return {"email": "true", "ip": rf"{x} rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'", "card": f"({n} between 13 and 19 and {_luhn(_digits(x))})", "phone": f"{n} between 9 and 15"}[kind]


def _featured(kind: str) -> str:
    """The added candidates of one generator: places, features, and checks where there are any."""
    check = {"pan": f"cast({_luhn(_digits('x.x'))} as int)", "account": f"if({_mod97(_bare)}, 1, null)"}.get(kind, "cast(null as int)")
    context = " ".join(f"when x.b rlike r'{w}' then {i}" for i, w in enumerate(_CONTEXT, 1))
    shape = " ".join(f"when x.x rlike r'{f}' then {i}" for i, f in enumerate(_SHAPE, 1))

    beside = "cast(concat(right(x.b, 1), coalesce(x.a, '')) rlike '[A-Za-z0-9_]' as int)"
    n = f"length({_digits('x.x')})"
    one = f"""struct(x.s as s, x.e as e, '{kind}' as kind, {KINDS.index(kind)} as gen, case when {n} < 7 then 0 when {n} < 9 then 1 when {n} < 13 then 2 when {n} < 20 then 3 else 4 end as digits,
        least(size(regexp_extract_all(x.x, '[0-9]+', 0)), 5) as groups, least(length(regexp_replace(x.x, r'[^ ().-]', '')), 3) as seps, case {shape} else 0 end as shape,
        case {context} else 0 end as context, {beside} as beside, {check} as check)"""
    return f"transform(raw_{kind}, x -> {one})"


def candidates(docs: DataFrame, keep: Column | str = "doc_id") -> DataFrame:
    """`kept`, `fold`, `base` (kind, s, e; in the order of kinds, then places) and `more`: (q, hit) of added
    candidates, where hit tells that a base span overlaps, with the weak label in q.label."""
    keep = F.col(keep) if isinstance(keep, str) else keep
    raw = docs.select(keep.alias("kept"), "text").selectExpr("kept", "text", f"pmod(xxhash64(text), {HELD}) = 0 as fold", *(f"{_spans(k)} as raw_{k}" for k in KINDS))
    base = [f"transform(filter(raw_{k}, x -> {_valid(k, 'x.x')}), x -> struct('{k}' as kind, x.s as s, x.e as e))" for k in BASE]
    raw = raw.selectExpr("kept", "fold", f"concat({', '.join(base)}) as base", f"filter(raw_phone, x -> not {_valid('phone', 'x.x')}) as failed", f"concat({', '.join(map(_featured, ADDED))}) as more")
    free = f"transform(filter({_touched('more', 'failed')}, z -> not z.hit or z.q.kind <> 'number'), z -> z.q)"
    raw = raw.selectExpr("kept", "fold", "base", f"if(size(more) > 0 and size(failed) > 0, {free}, more) as more")
    # Seen on a base phone or card: personal data.
    seen = _touched("more", "filter(base, b -> b.kind in ('phone', 'card'))")
    label = f"coalesce(if(z.hit and z.q.kind in ('number', 'dial', 'longdial', 'pan'), 1, null), z.q.check, if(z.q.context = {HARMLESS}, 0, null))"
    fields = ", ".join(f"z.q.{f} as {f}" for f in ("s", "e", "kind", *FEATURES))
    raw = raw.selectExpr("kept", "fold", "base", f"transform({seen}, z -> struct({fields}, {label} as label)) as more")
    return raw.selectExpr("kept", "fold", "base", f"{_touched('more', 'base')} as more")


def examples() -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of the examples."""
    out = []
    for forms, sentences, label in EXAMPLES:
        for form, sentence in itertools.product(forms, sentences):
            at = sentence.index("{}")
            out.append((sentence.replace("{}", form), at, at + len(form), label))
    return out


def _counted(found: DataFrame, label: str) -> list[tuple[tuple[int, ...], int, bool, int]]:
    """(features, label, held out, count) of labelled candidates: bounded by the features' product."""
    rows = found.selectExpr("fold", f"explode(transform(more, z -> struct({', '.join(f'z.q.{f}' for f in FEATURES)}, {label} as label))) as x").filter("x.label is not null")
    counted = rows.groupBy("fold", *(f"x.{f}" for f in FEATURES), "x.label").agg(F.count("*").alias("n")).collect()
    return [(tuple(r[f] for f in FEATURES), r["label"], r["fold"], r["n"]) for r in counted]


def _weighted(rows: list[tuple[tuple[int, ...], int, bool, int]]) -> list[tuple[tuple[int, ...], int, bool, float]]:
    total: dict[int, int] = {}
    for x, _, _, n in rows:
        total[x[0]] = total.get(x[0], 0) + n
    return [(x, y, fold, WEIGHT * n / total[x[0]]) for x, y, fold, n in rows]


def grow(rows: list[tuple[tuple[int, ...], int, float]]) -> list:
    """Boosted trees over weighted distinct feature rows: nested (feature, cut, left, right) or values."""
    margin = [0.0] * len(rows)
    trees = []

    def value(own: list[int], g: list[float], h: list[float]) -> float:
        return round(-RATE * sum(g[i] for i in own) / (sum(h[i] for i in own) + RIDGE), 6)  # as in _case, or scores would miss their thresholds

    def split(own: list[int], g: list[float], h: list[float], depth: int):
        if depth == 0:
            return value(own, g, h)
        ga, ha = sum(g[i] for i in own), sum(h[i] for i in own)
        best = (1e-6, None, None)
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in own:
                s = by.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            gl = hl = 0.0
            for cut in sorted(by)[:-1]:
                gl, hl = gl + by[cut][0], hl + by[cut][1]
                gain = gl * gl / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga * ga / (ha + RIDGE)
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is None:
            return value(own, g, h)
        f, cut = best[1:]
        return f, cut, split([i for i in own if rows[i][0][f] <= cut], g, h, depth - 1), split([i for i in own if rows[i][0][f] > cut], g, h, depth - 1)

    for _ in range(TREES if rows else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [r[2] * (q - r[1]) for r, q in zip(rows, p, strict=True)]
        h = [r[2] * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        tree = split(list(range(len(rows))), g, h, DEPTH)
        trees.append(tree)
        margin = [m + walk(tree, r[0]) for m, r in zip(margin, rows, strict=True)]
    return trees


def walk(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if x[f] <= cut else right
    return tree


def _case(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    f, cut, left, right = tree
    return f"if(z.q.{FEATURES[f]} <= {cut}, {_case(left)}, {_case(right)})"


def threshold(scored: list[tuple[float, int, float]]) -> float:
    """The lowest score to let through, from held-out (score, label, weight)."""
    by: dict[float, list[float]] = {}
    for m, y, n in scored:
        level = by.setdefault(round(m, 6), [0.0, 0.0])
        level[0] += n * y
        level[1] += n
    good = whole = 0.0
    cut = math.inf
    for m in sorted(by, reverse=True):
        good, whole = good + by[m][0], whole + by[m][1]
        if m <= 0 or by[m][0] < LEVEL * by[m][1] or good < PRECISION * whole:
            break
        cut = m
    return cut


def learn(found: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees, and each generator's threshold."""
    made = found.sparkSession.sql("select inline(from_json(:made, 'array<struct<text:string,x_s:bigint,x_e:bigint,x_label:int>>'))", args={"made": json.dumps([dict(zip(("text", "x_s", "x_e", "x_label"), x, strict=True)) for x in examples()])})
    own = candidates(made, F.struct("x_s", "x_e", "x_label"))
    rows = _weighted(_counted(found, "z.q.label")) + _weighted(_counted(own, "if(z.q.s < kept.x_e and z.q.e > kept.x_s, kept.x_label, null)"))
    trees = grow(sorted((x, y, w) for x, y, fold, w in rows if not fold))
    score = lambda x: sum(walk(t, x) for t in trees)
    return trees, {gen: threshold([(score(x), y, w) for x, y, fold, w in rows if fold and x[0] == gen]) for gen in range(len(BASE), len(KINDS))}


def _best(more: str) -> str:
    """Of spans (s, e, kind, gen, score) that overlap in a chain, the best; sorted by kind and place."""

    def grouped(x: str) -> str:
        far = running(f"transform({x}, y -> y.e)", _max, "-1L")
        group = lambda f: running(f"transform({x}, (y, i) -> if(i = 0 or y.s >= {f}[greatest(i - 1, 0)], 1, 0))", _add, "0")
        return _let(far, lambda f: _let(group(f), lambda g: chosen(x, g)))

    def chosen(x: str, g: str) -> str:
        ranked = f"zip_with({x}, {g}, (y, k) -> struct(k as k, y.score as score, -y.gen as g, -y.s as m, y.e as e, y.kind as kind))"
        low = "struct(-1 as k, 0D as score, 0 as g, 0L as m, 0L as e, '' as kind)"
        return f"filter({running(ranked, _max, low)}, (y, i) -> i = size({g}) - 1 or {g}[least(i + 1, size({g}) - 1)] <> y.k)"

    return f"sort_array(transform({_let(f'sort_array({more})', grouped)}, y -> struct(-y.g as gen, -y.m as s, y.e as e, y.kind as kind, y.score as score)))"


def choose(found: DataFrame, trees: list, cuts: dict[int, float]) -> DataFrame:
    """`kept` and `spans` of all rows: base spans, and added ones that pass their threshold."""
    margin = " + ".join(map(_case, trees)) or "0D"
    own = [f"(x.gen = {g} and x.score >= {c - 1e-6!r}D)" for g, c in cuts.items() if math.isfinite(c)]
    scored = found.selectExpr("kept", "base", f"transform(filter(more, z -> not z.hit), z -> struct(z.q.s as s, z.q.e as e, z.q.kind as kind, z.q.gen as gen, {margin} as score)) as more")
    scored = scored.selectExpr("kept", "base", f"filter(more, x -> {' or '.join(own) or 'false'}) as more")
    # Base spans have no margin of the trees: their rule has confirmed them.
    base = "transform(base, b -> struct(b.kind as kind, b.s as start, b.e as end, true as base, 1D as score))"
    more = f"transform({_best('more')}, y -> struct(y.kind as kind, y.s as start, y.e as end, false as base, 1 / (1 + exp(-y.score)) as score))"
    return scored.selectExpr("kept", f"if(size(more) > 0, concat({base}, {more}), {base}) as spans")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and `spans` (kind, start, end, base, score) of every row: base spans and added ones."""
    found = work.save(candidates(docs), "candidates")
    return choose(found, *learn(found)).withColumnRenamed("kept", "doc_id")


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """The rows and columns of `docs` with every span replaced; overlapping spans become one. A row keeps
    its own spans (no join by id), so null and repeated ids are redacted like others."""
    found = work.save(candidates(docs), "candidates")
    both = choose(candidates(docs, F.struct("*")), *learn(found)).selectExpr("kept", "kept.text as text", "spans")
    work.drop(found)

    def cleaned(x: str) -> str:
        """Text between groups of overlapping spans, joined by marks."""
        far = running(f"transform({x}, y -> y.e)", _max, "0L")
        return _let(far, lambda f: _let(between(x, f), lambda w: f"array_join({parts(x, w)}, '{mark}')"))

    def between(x: str, f: str) -> str:
        heads = f"transform({x}, (y, i) -> if(i = 0 or y.s >= {f}[greatest(i - 1, 0)], struct(if(i = 0, 0L, {f}[greatest(i - 1, 0)]) as a, y.s as b), null))"
        return f"concat(filter({heads}, y -> y is not null), array(struct({f}[size({x}) - 1] as a, cast(length(text) as bigint) as b)))"

    def parts(x: str, w: str) -> str:
        one = f"transform({w}, y -> substr(text, cast(y.a as int) + 1, cast(y.b - y.a as int)))"
        # Many spans: code points once as an array, as a substring is looked for from the text's start.
        many = _let("split(text, '')", lambda c: f"transform({w}, y -> array_join(slice({c}, cast(y.a as int) + 1, cast(y.b - y.a as int)), ''))")
        return f"if(size({x}) > 64, {many}, {one})"

    places = "sort_array(transform(spans, y -> struct(y.start as s, y.end as e)))"
    both = both.selectExpr("kept", f"if(text is null or size(spans) = 0, text, {_let(places, cleaned)}) as clean")
    return both.select(*(F.col("clean").alias(c) if c.lower() == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`."""
    found = find(table(spark, sf_dir, "documents"))
    text = "array_join(transform({}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')"
    count = [f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint) as n_{k}" for k in BASE]
    return found.selectExpr("doc_id", *count, f"sha2({text.format('filter(spans, x -> x.base)')}, 256) as base_sha256", f"{text.format('spans')} as spans")
