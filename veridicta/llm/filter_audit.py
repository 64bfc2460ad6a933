"""What five quality filters remove together, apart and in every order: an audit by words in relational form.

Texts that are equal meet first: each distinct text is kept once, with the least id that has it, so a text that a third
of all rows repeat is looked at once.  Its words are exploded, aggregated by (document, word) and then by document, for
totals and distincts; both aggregations stay where the exchange by text has put the texts.  The other flags are
outer-joined to these.  Documents are counted by (text, part, labels) before any exchange by text; such a cell needs
only its least id to say which of its rows repeat a smaller one's text.  32 conditional counts a part, one for each set
of filters that fail, hold all that the audit asks: the 120 orders of five steps are sums over them.

Filters (bits 1, 2, 4, 8, 16): A too few words, B too few distinct words, C too many capitals, D a forbidden sign,
E the text of a smaller id.  Null text: empty.  Null lang: the part ''.  A null id is larger than all others; rows of
one id don't repeat each other.  Repeated rows count as often as they are there.  A document that several rows of labels
name has the larger of each label; null labels are none.  Columns other than doc_id, text, lang (labels: doc_id, quality,
toxic) are not looked at.  Empty table: no parts, no rows.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.llm.common import WORD

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # percent of the words
MOST_CAPITALS = 10  # percent of the code points
SIGNS = r"[#$%&*|]"
_SETS = 1 << len(FILTERS)
_E = 16


def _digest():
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest")


def word_counts(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, text) -> (doc_id, digest, words, distinct) of the texts that have words."""
    words = texts.select("doc_id", "digest", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    pairs = words.groupBy("doc_id", "digest", "word").agg(F.count("*").alias("n"))
    return pairs.groupBy("doc_id", "digest").agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def text_flags(documents: DataFrame) -> DataFrame:
    """(digest, fails) of each distinct text: the bits of the filters A to D that it fails."""
    texts = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest())
        .groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    )
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    signs = texts.select(
        F.col("digest").alias("of"), (F.when(100 * capitals > MOST_CAPITALS * F.length("text"), 4).otherwise(0) + F.when(F.col("text").rlike(SIGNS), 8).otherwise(0)).alias("signs")
    )
    counts = word_counts(texts)
    both = signs.join(counts, signs["of"] == counts["digest"], "left").na.fill(0, ["words", "distinct"])
    fails = F.when(F.col("words") < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"), 2).otherwise(0)
    return both.select(F.col("of").alias("digest"), (F.col("signs") + fails).alias("fails"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, part, good, toxic): how many rows, and how many of these fail E."""
    d = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), _digest())
    d = d.withColumn("null_id", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))  # null ids don't meet in one task
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.withColumn("never", F.lit(0).cast("long"))
    d = d.join(marks, (d["doc_id"] == marks["of"]) & (d["null_id"] == marks["never"]), "left")
    kinds = ["digest", "part", "good", "toxic"]
    d = d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    rows = d.groupBy("doc_id", "null_id", *kinds).agg(F.count("*").alias("n")).withColumn("id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    by_kind = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(W.partitionBy("digest"))
    firsts = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    same = F.when(F.col("least.none"), F.col("n")).otherwise(firsts)  # no id is smaller than a null one among nulls only
    return by_kind.withColumn("least", least).select(*kinds, "n", (F.col("n") - same).alias("repeats"))


def fail_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part: for all rows, the good and the toxic ones an array of 32 counts, by the bits of the filters that fail."""
    c, t = cells(documents, labels), text_flags(documents).withColumnRenamed("digest", "of")
    c = c.join(t, c["digest"] == t["of"])

    def counts(name: str, kind) -> list:
        return [
            F.sum(F.when(kind & (F.col("fails") == (s & ~_E)), F.col("repeats") if s & _E else F.col("n") - F.col("repeats")).otherwise(0)).alias(f"{name}{s}") for s in range(_SETS)
        ]

    sums = c.groupBy("part").agg(*counts("all", F.lit(True)), *counts("good", F.col("good")), *counts("toxic", F.col("toxic")))
    return sums.select("part", *(F.array(*(F.col(f"{k}{s}") for s in range(_SETS))).alias(k) for k in ("all", "good", "toxic")))


def _steps():
    """All orders and steps: the order, the step, its filter's bit and the bits of the filters before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    per_part = fail_sets(documents, labels)
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    x = per_part.withColumn("__s", F.explode(steps)).select("*", "__s.*")
    bit, before, sets = F.col("bit"), F.col("before"), F.array(*(F.lit(s) for s in range(_SETS)))

    def total(counts: str, holds):
        """Sum over the sets for which ``holds`` is true."""
        return F.aggregate(F.zip_with(counts, sets, lambda n, s: F.when(holds(s), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n)

    fails, earlier = lambda s: s.bitwiseAND(bit) != 0, lambda s: s.bitwiseAND(before) != 0
    here = lambda s: fails(s) & ~earlier(s)
    # of the orders, a set's filters come first equally often
    share = F.aggregate(
        F.zip_with("all", sets, lambda n, s: F.when(fails(s), n * (F.lit(factorial(len(FILTERS))) / F.bit_count(s)).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n
    )
    return x.select(
        "part", "filter_order", "step", total("all", lambda s: s.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda s: fails(s) & earlier(s)).alias("redundant"), F.element_at("all", bit + 1).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY ALL),
x AS (
  SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i) JOIN x d ON d.i NOT IN (a.i, b.i, c.i) JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (
  SELECT p, list_aggregate(list_transform(p, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, CAST(i AS INTEGER) AS step, p[i] AS f, p[1:i - 1] AS before FROM o, x),
r AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, fails[f] AS hit, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda v: v)) AS k FROM c, s),
a AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE hit AND k = 1), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a
"""
