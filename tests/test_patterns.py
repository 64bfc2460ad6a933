"""Many patterns at once: nothing is found that a search of each wouldn't find, and nothing is missed."""

import random
import sys

from pyspark.sql import functions as F

from veridicta.functions import packs
from veridicta.functions.expressions import re_
from veridicta.functions.patterns import Patterns, fold, needed

PACKS = [p for r in (*packs.TOPIC_RULES, *packs.ACTION_RULES, *packs.ACTION_NEGATIONS, *packs.EVIDENCE) for p in r.patterns] + [packs.HAS_NUMBERS, packs.FUTURE_YEAR, *packs.KPI_VALUES]
SYNTHETIC = [p for r in (*packs.SYNTHETIC_TOPIC_RULES, *packs.SYNTHETIC_ACTION_RULES, *packs.SYNTHETIC_EVIDENCE) for p in r.patterns]


def test_strings_that_a_match_must_hold():
    for pattern, want in {
        r"\b(tree|trees|bush)\b": {"tree", "bush"}, r"net[\-\s]?zero": {"zero"}, r"(a|b)?x{2,}": {"x"}, r"\d+": None, r"[0-9]{2,}": set("0123456789"), r"(?:ab|\d)c": {"c"}, r"a*": None,
        r"(so với|as).*\d+": {"so với", "as"}, r"(?i)Straße": {"strasse"}, r"colou?r": {"color", "colour"}, r"(red|(green|blue)+) cat": {" cat"}, r"x(?=yz)": {"x"}, r"[^a]bc": {"bc"}, r"(foo|)": None,
    }.items():
        got = needed(pattern)
        assert (got and set(got)) == want, pattern
    assert all(needed(p) for p in PACKS)


def texts(seed, n):
    """Words of the packs and others, in any case, with what looks like them."""
    rng = random.Random(seed)
    words = [w for p in PACKS + SYNTHETIC for s in (needed(p) or ()) for w in s.split()] + ["2025", "năm 2021", "12,5 %", "3 tỷ đồng", "Scope 1", "Q4/2023", "iso 14001", "ſtaff", "K", "İn", "ının", "Ngân hàng", "xx", "7", "|", "\n", "the", "tion"]
    twist = [str.lower, str.upper, str.title, lambda w: w.replace("s", "ſ"), lambda w: w.replace("i", "İ"), lambda w: w.replace("i", "ı"), lambda w: w.replace("k", "K"), lambda w: w + "x", lambda w: w[1:]]
    return [None, "", " "] + [rng.choice([" ", " ", ""]).join(rng.choice(twist[: rng.choice([1, 3, 9])])(w) for w in rng.choices(words, k=rng.randint(1, 25))) for _ in range(n)]


def test_same_as_searching_each(spark):
    for patterns in (PACKS, SYNTHETIC, [r"\d+", r"a*"], []):
        known = Patterns(patterns)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(7, 400))], "i int, t string").withColumn("m", known.mask(F.col("t")))
        t = F.coalesce("t", F.lit(""))
        for part in (patterns[i : i + 40] for i in range(0, len(patterns), 40)):
            for both in df.select(F.array(*(t.rlike(re_(p)) for p in part)).alias("plain"), F.array(*(known.has(F.col("m"), t, p) for p in part)).alias("known")).collect():
                assert both["plain"] == both["known"]


def test_characters_that_a_search_takes_for_equal_fold_alike(spark):
    pairs = set()
    for k in range(1, sys.maxunicode if False else 0x20000):
        if not 0xD800 <= k < 0xE000:
            c = chr(k)
            pairs |= {(c, d) for d in {c.lower(), c.upper(), c.title(), c.casefold(), c.swapcase(), c.lower().upper(), c.upper().lower()} if len(d) == 1 and d != c}
    cased = sorted({c for p in pairs for c in p})
    by_fold = {}
    for c in cased:
        by_fold.setdefault(c.lower().upper()[:1].lower(), []).append(c)
    pairs |= {(c, d) for group in by_fold.values() for c in group for d in group if c != d}
    df = spark.createDataFrame(sorted(pairs), "a string, b string").repartition(4)
    equal = df.where(F.expr(r"a rlike concat('(?iuUd)^', '\\Q', b, '\\E', '$')")).collect()
    assert len(equal) > 2000
    assert [(r["a"], r["b"]) for r in equal if fold(r["a"]) != fold(r["b"])] == []


def test_mask_spans_words(spark):
    """More patterns than bits of a word."""
    many = [f"word{i:03d}" for i in range(150)]
    known = Patterns(many)
    assert known.words == 3
    df = spark.createDataFrame([("WORD000 word149",), ("word061word062word063",)], "t string").withColumn("m", known.mask(F.col("t")))
    got = [[i for i, x in enumerate(r[0]) if x] for r in df.select(F.array(*(known.has(F.col("m"), F.col("t"), p) for p in many))).collect()]
    assert got == [[0, 149], [61, 62, 63]]
