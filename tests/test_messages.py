"""Messages hold every name of their key."""

from __future__ import annotations

from provena.operators import digests
from provena.plans import registry

from . import oracle


def test_one_message_holds_all_names_of_a_brand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "CHUNK", 100)
    rows = [(k, ("B1", "B2", "B3", None)[k % 4], 50 if k % 5 else 40, None if k % 4 == 2 or k % 7 == 0 else f"näme {k * 37 % 900}") for k in range(3000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string").repartition(6).write.parquet(f"{tmp_path}/part.parquet")
    name = "o06_unconsumed_message"
    assert oracle.difference(registry.QUERIES[name](spark, str(tmp_path)), registry.SQL[name], oracle.connect(str(tmp_path))) == ""
    got = {r.p_brand: r.message for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {"B1", "B2", "B3", None} and got["B3"] is None
    assert got["B1"].split(": ", 1)[1].split(", ") == sorted(n for k, b, s, n in rows if b == "B1" and s > 40 and n)
