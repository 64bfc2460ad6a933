"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Of all ways to take w(s) words of each source, the one nearest to the corpus (least relative entropy against taking
every document once) gives each document the rate exp(l), l being its source's multiplier in the convex dual
``sum(size * exp(l)) - target * l``.  The gradient and curvature of the dual need one number a source, its words, so
one distributed pre-aggregated sum serves all Newton iterations.  Rates become whole copies: every document gets
floor(rate).  The rest of the target goes to some documents once more: of a source's few large ones, longest first,
each is chosen if the share owed to it and carried over from the ones before reaches half its size; small ones follow
in the order of their ids' digests for what the large ones leave open.  So the words taken miss the target by about
half a small document.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; a target above ``cap`` times the source's
words stops there and the excess goes to the others by weight, until none is above.

Sizes are counted once and kept in a checkpoint.  Running sums over a source go by (source, bucket of the digest) with
one sum a bucket, so a source that holds a third of all rows is spread over 256 tasks, or 65,536 in a large table.  Null text: no words.  Repeated rows are rows of their own.  Sources
without words, and empty tables, take nothing.  Clashing names: the columns that ``mix`` adds
replace the input's; ``take`` adds none and keeps all of the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.llm.common import WORD, cut, unused

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
LARGE = 1 / 256  # of the source's words; so a source has fewer than 256 large documents
NEWTON_STEPS = 64
LARGE_TABLE = 1 << 26  # rows from which a source is dealt into 65,536 buckets instead of 256; the mix is the same
_ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
_READ = ("doc_id", "text", "source")


def words_in(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also weight, target.  One row a source, so ordering them in one task is small."""
    in_order = W.orderBy(F.col("source").isNull(), "source")
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    s = sources.withColumn("weight", F.element_at(kinds, (F.row_number().over(in_order) - 1) % len(weights) + 1))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    by_need = W.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()),
        "full": F.coalesce(F.sum("top").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing)),
        "turn": F.row_number().over(by_need),
    })
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("top") / F.col("weight"), F.struct("turn", "level"))
    s = s.withColumn("level", F.min(fits).over(W.partitionBy())["level"])
    return s.select("source", "source_size", "weight", F.least("top", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def newton_rate(size: Column, target: Column) -> Column:
    """exp(l) at the least of size * exp(l) - target * l, by Newton steps from l = 0."""
    ratio = target / size
    multiplier = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), lambda l, _: l - 1.0 + ratio * F.exp(-l))
    return F.when((size > 0) & (target > 0), F.exp(multiplier)).otherwise(0.0)


def _apart(documents: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The input with all columns but the three that are read under names of our own, so that none of theirs is taken for
    one of ours; and the name of each column to keep."""
    names = dict(zip(keep, unused(_ADDED, *(f"in{i}" for i in range(len(keep)))), strict=True))
    names |= {c: c for c in keep if c.lower() in _READ}
    read = [c for c in documents.columns if c.lower() in _READ]
    return documents.select(*read, *(F.col(f"`{c}`").alias(n) for c, n in names.items() if c not in read)), names


def mix(documents: DataFrame, weights=WEIGHTS, cap: float = CAP, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All rows of (doc_id, text, source, ...) with size, source_size, target, rate, copies, taken.  ``columns``: those of
    the input to keep; without the text, no text is read twice."""
    d, names = _apart(documents, [c for c in documents.columns if c.lower() not in _ADDED and (columns is None or c in columns)])
    return _mixed(d, weights, cap, [*names.values()]).select(*(F.col(n).alias(c) for c, n in names.items()), *_ADDED)


def _mixed(documents: DataFrame, weights, cap: float, names: list[str], plan_of=None) -> DataFrame:
    """``plan_of``: (source, source_size) -> also weight, target, in place of ``targets``."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    whole = documents.withColumn("size", words_in()).withColumn("__digest", digest)
    rows = cut(whole.select(*dict.fromkeys(["doc_id", "source", "size", "__digest", *(names if "text" not in names else ())])))
    digits = 2 if rows.count() < LARGE_TABLE else 4  # of the digest, that name a bucket
    bucket = F.substring("__digest", 1, digits)
    sized = rows.withColumn("__bucket", bucket)
    d = sized if "text" not in names else whole.select(*names, "size", "__digest").withColumn("__bucket", bucket)

    cells = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("size"))
    sources = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = plan_of(sources) if plan_of else targets(sources, weights, cap)
    plan = plan.withColumn("rate", newton_rate(F.col("source_size"), F.col("target")))
    plan = plan.withColumn("__base", F.floor(F.col("rate") + 1e-9)).withColumn("__share", F.greatest(F.round(F.col("rate") - F.col("__base"), 9), F.lit(0.0)))
    plan = plan.withColumn("__large", F.col("source_size") * LARGE).drop("weight")

    def with_plan(x: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        r = right.withColumnsRenamed({c: f"__r_{c}" for c in ("source", *more)})
        on = x["source"].eqNullSafe(r["__r_source"])
        for c in more:
            on = on & (x[c] == r[f"__r_{c}"])
        return x.join(r, on).drop(*(f"__r_{c}" for c in ("source", *more)))

    def by_cell(p: DataFrame) -> DataFrame:
        """A source's plan at each of its buckets, so that joining it deals no source into one task."""
        c = cells.select(F.col("source").alias("__c"), "__bucket")
        return c.join(p, c["__c"].eqNullSafe(p["source"])).drop("__c")

    order = ["__digest", "doc_id", "size"]
    is_large = F.col("size") > F.col("__large")

    def midway(window) -> Column:
        return F.sum("size").over(window.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2

    # large documents, fewer than 256 a source: longest first, each passes on what its choice is off by
    slim = with_plan(sized.select("doc_id", "source", "size", "__digest", "__bucket"), by_cell(plan), "__bucket")
    by_size = [F.col("size").desc(), *order]
    listed = slim.where(is_large).groupBy("source", "__share").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("n"), "__digest", "doc_id"))).alias("all"))
    start = F.struct(F.lit(0.0).alias("carry"), F.lit(0).cast("long").alias("got"), F.array().cast("array<boolean>").alias("chosen"))

    def choose(state, x):
        size = -x["n"]
        carry = state["carry"] + F.col("__share") * size
        yes = carry >= size / F.lit(2.0)
        return F.struct(
            (carry - F.when(yes, size).otherwise(0)).alias("carry"),
            (state["got"] + F.when(yes, size).otherwise(0)).alias("got"),
            F.concat(state["chosen"], F.array(yes)).alias("chosen"),
        )

    got = listed.withColumn("s", F.aggregate("all", start, choose)).select(F.col("source").alias("__g"), F.col("s.got").alias("__got"), F.col("s.chosen").alias("__chosen"))
    plan2 = plan.join(got, plan["source"].eqNullSafe(got["__g"]), "left").drop("__g").na.fill(0, ["__got"])
    plan2 = plan2.withColumn("__rest", F.greatest(F.col("__share") * F.col("source_size") - F.col("__got"), F.lit(0.0)))

    # small ones: a running sum in each bucket, from where the buckets before it end
    small = slim.where(~is_large).groupBy("source", "__bucket").agg(F.sum("size").alias("__n"))
    offsets = small.withColumn(
        "__offset", F.coalesce(F.sum("__n").over(W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("__n")
    o, p = offsets.withColumnsRenamed({"source": "__o_source", "__bucket": "__o_bucket"}), by_cell(plan2)
    p = p.join(o, p["source"].eqNullSafe(o["__o_source"]) & (p["__bucket"] == o["__o_bucket"]), "left").drop("__o_source", "__o_bucket")
    full = with_plan(d, p, "__bucket")
    kind = F.when(is_large, F.lit("")).otherwise(F.col("__bucket"))  # all large ones of a source together
    at = midway(W.partitionBy("source", is_large, kind).orderBy(*order)) + F.coalesce("__offset", F.lit(0))
    turn = F.row_number().over(W.partitionBy("source", is_large, kind).orderBy(*by_size))
    extra = F.when(is_large, F.element_at("__chosen", F.col("__turn"))).otherwise(F.col("__at") <= F.col("__rest"))
    full = full.withColumn("__at", at).withColumn("__turn", turn)
    copies = (F.col("__base") + F.when(extra & (F.col("size") > 0) & (F.col("__share") > 0), 1).otherwise(0)).cast("int")
    full = full.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return full.select(*names, *_ADDED)


def take(documents: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns unchanged."""
    d, names = _apart(documents, documents.columns)
    copies = _mixed(d, weights, cap, [*names.values()]).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*(F.col(n).alias(c) for c, n in names.items()))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
         source_size * 3 AS top, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY top / weight, source NULLS LAST) AS turn, (total - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(top, weight * coalesce((SELECT arg_min(level, turn) FILTER (WHERE level <= top / weight) FROM l), 0)) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, source_size / 256 AS large FROM t),
q AS (
  SELECT *, floor(rate + 1e-9) AS base, greatest(round(rate - floor(rate + 1e-9), 9), 0) AS share FROM p),
e AS (
  SELECT d.*, q.source_size, q.target, q.base, q.share, d.size > q.large AS is_large FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY source, is_large ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS midway,
         row_number() OVER (PARTITION BY source, is_large ORDER BY size DESC, digest, doc_id) AS turn FROM e),
c AS (
  SELECT source, turn, share * size - CASE WHEN share * size >= size / 2.0 THEN size ELSE 0 END AS carry, share * size >= size / 2.0 AS chosen
  FROM r WHERE is_large AND turn = 1
  UNION ALL
  SELECT r.source, r.turn, c.carry + share * size - CASE WHEN c.carry + share * size >= size / 2.0 THEN size ELSE 0 END, c.carry + share * size >= size / 2.0
  FROM c JOIN r ON r.is_large AND r.source IS NOT DISTINCT FROM c.source AND r.turn = c.turn + 1),
g AS (
  SELECT r.source, sum(CASE WHEN r.is_large AND c.chosen THEN size ELSE 0 END) AS got
  FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.turn = c.turn GROUP BY r.source),
f AS (
  SELECT r.*, base + CASE WHEN size > 0 AND share > 0 AND CASE WHEN is_large THEN c.chosen ELSE midway <= greatest(share * source_size - got, 0) END
                          THEN 1 ELSE 0 END AS copies
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON r.is_large AND r.source IS NOT DISTINCT FROM c.source AND r.turn = c.turn)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies AS INTEGER) AS copies, CAST(size * copies AS BIGINT) AS taken FROM f
"""
