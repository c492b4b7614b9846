"""op5: boilerplate lines taken out of texts, against a plain version over split lines."""

from __future__ import annotations

import collections
import random
import re

from provena.llm import op5_lines

from .conftest import SCHEMA, make


def normal(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def test_lines_are_removed_where_they_stand(spark):
    rng = random.Random(4)
    often = ["the same footer here", "All Rights reserved © here", "more of these é lines", "x y"]
    texts = []
    for i in range(160):
        lines = [rng.choice([f"own line number {i} {k}", "", "  ", rng.choice(often), rng.choice(often).upper(), f" \t{rng.choice(often)}  "]) for k in range(rng.randint(1, 9))]
        texts.append(rng.choice(["", "\n", "\n\n"]) + "\n".join(lines) + rng.choice(["", "\n", "\n \n"]))
    texts += [None, "", "\n", often[0], often[0] + "\n" + often[1]]
    rows = make(texts, sources=[("a", "b", None)[i % 3] for i in range(len(texts))])
    held = collections.defaultdict(set)
    for i, t, _, host, *_ in rows:
        for line in (t or "").split("\n"):
            if len(normal(line).split()) >= op5_lines.LINE_WORDS:
                held[host, normal(line)].add(t)
    in_all = collections.Counter()
    for (_, line), own in held.items():
        in_all[line] += len(own)
    gone = {k for k, own in held.items() if len(own) > op5_lines.HOST_LIMIT or in_all[k[1]] > op5_lines.ALL_LIMIT}
    assert len(gone) > 3
    want = {i: t and "\n".join(line for line in t.split("\n") if (host, normal(line)) not in gone) for i, t, _, host, *_ in rows}
    got = {r.doc_id: r.text for r in op5_lines.strip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and sum(want[i] != t for i, t, *_ in rows) > 50
