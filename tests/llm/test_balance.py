"""Mixing by shares of two columns at once, against proportional fitting in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridicta.llm import balance, entropy_mix

WANTS = {"source": {"web": 0.5, "book": 0.3, None: 0.2}, "lang": {"en": 0.4, "de": 0.6}}


def rows(n=400):
    rng = random.Random(4)
    return [(i, "w " * rng.randint(1, 60), rng.choices(["web", "book", None], (6, 2, 2))[0], rng.choice(["en", "de"]), f"c{i}") for i in range(n)] + [(n, None, "web", "en", "c"), (n + 1, "", "book", "de", "c"), (5, "w w", "web", "en", "c5")]


def fitted(cells, wants, total):
    """Rates by scaling one column's sums after the other's until nothing changes."""
    rate = {k: 1.0 for k in cells}
    for _ in range(2000):
        for at, shares in enumerate(wants.values()):
            for v, s in shares.items():
                got = sum(cells[k] * rate[k] for k in cells if k[at] == v)
                for k in cells:
                    if k[at] == v:
                        rate[k] *= s * total / got
    return rate


def test_rates_are_those_of_proportional_fitting(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id int, text string, source string, lang string, copies string")
    got = balance.balance(df.drop("copies").withColumn("target", F.lit("theirs")), WANTS, cap=50.0).collect()
    cells, total = {}, 0
    for _, t, s, g, _ in data:
        n = len((t or "").split())
        cells[s, g], total = cells.get((s, g), 0) + n, total + n
    want = fitted(cells, WANTS, total)
    assert len(got) == len(data) and all(r["target"] == "theirs" for r in got)
    for r in got:
        assert r["rate"] == pytest.approx(want[r["source"], r["lang"]], rel=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and (r["size"] == 0 or abs(r["copies"] - r["rate"]) < 1 + 1e-9)
    for at, (c, shares) in enumerate(WANTS.items()):
        for v, s in shares.items():
            assert sum(r["taken"] for r in got if r[c] == v) == pytest.approx(s * total, rel=0.03), (c, v)
    again = balance.balance(df.drop("copies").repartition(3), WANTS, cap=50.0).collect()
    assert sorted((r["doc_id"], r["size"], r["copies"]) for r in again) == sorted((r["doc_id"], r["size"], r["copies"]) for r in got)


def test_a_value_without_a_share_is_free_and_the_cap_holds(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "en" if i < 80 else "de") for i in range(100)], "doc_id int, text string, source string, lang string")
    free = {(r["source"], r["lang"]): r["rate"] for r in balance.balance(df, {"lang": {"de": 0.4}}, cap=3.0).collect()}
    assert free["a", "de"] == free["b", "de"] == pytest.approx(2) and free["a", "en"] == pytest.approx(1)
    both = balance.balance(df, {"lang": {"de": 0.55, "en": 0.6}, "source": {"a": 0.6, "b": 0.55}}, cap=3.0).collect()
    assert max(r["rate"] for r in both) <= 3 + 1e-9
    for c, v, s in (("lang", "de", 0.55), ("source", "a", 0.6)):
        assert sum(r["rate"] * 10 for r in both if r[c] == v) == pytest.approx(s * 1000, rel=1e-6)
    with pytest.raises(ValueError, match="no rates up to 3"):
        balance.balance(df, {"lang": {"de": 0.9}}, cap=3.0)
    with pytest.raises(ValueError, match="has no words"):
        balance.balance(df, {"lang": {"fr": 0.1}})


def test_one_column_is_the_plain_mix_and_empty_tables_take_nothing(spark):
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows()], "doc_id int, text string, source string")
    plain = entropy_mix.mix(df)
    words = plain.agg(F.sum("size")).first()[0]
    shares = {r["source"]: r["target"] / words for r in plain.select("source", "target").distinct().collect()}
    got = balance.balance(df, {"source": shares})
    pick = lambda d: sorted((r["doc_id"], r["size"], r["copies"]) for r in d.collect())
    assert pick(got) == pick(plain)
    assert balance.balance(df.limit(0), {"source": {"web": 1.0}}).count() == 0
    none = balance.balance(df.where("text IS NULL OR text = ''"), {"source": {"web": 1.0}}).collect()
    assert len(none) == 2 and all(r["taken"] == 0 for r in none)
    assert np.allclose([r["rate"] for r in none], 0)
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString() and "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
