"""Labels from two annotators: pre-label parsing and resuming, reconciliation, agreement, splits, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import dbl, free
from veridicta.functions.packs import ACTIONS, TOPICS
from veridicta.plans.lineage import kept, settled


def wants_label(df: DataFrame, text: str = "sentence", least: int = 20) -> DataFrame:
    """Texts for labeling: no image marks, no bare numbers (null counts as neither), long enough."""
    t = F.col(text)
    odd = F.coalesce(t.rlike(r"<!-- image -->|^\d+$"), F.lit(False))
    return df.where(~odd & (F.length(t) >= least))


def not_yet(df: DataFrame, done: DataFrame, key: str = "sent_id") -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def parse_reply(reply: Column, field: str, default: str) -> tuple[Column, Column, Column]:
    """(label, confidence, reason) from the first { to the last } of an external labeler's reply."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, f"{field} string, confidence double, reason string")
    good = parsed[field].isNotNull()
    return (
        F.when(good, parsed[field]).otherwise(default),
        F.when(good, F.coalesce(parsed["confidence"], dbl(0.5))).otherwise(dbl(0.5)),
        F.when(good, F.coalesce(parsed["reason"], F.lit(""))).otherwise("parse_error"),
    )


def reconcile(df: DataFrame, out: str = "topic", domain=TOPICS, first: str = "llm_label", confidence: str = "llm_confidence", second: str = "rule_label") -> DataFrame:
    """Adds <out>_label, <out>_confidence, label_source."""
    a, b, c = F.col(first), F.col(second), F.coalesce(F.col(confidence), dbl(0))
    inside = lambda x: F.coalesce(x.isin(*domain), F.lit(False))
    both, same = inside(a) & inside(b), a == b
    return df.withColumns({
        f"{out}_label": F.when(inside(a), a).when(inside(b), b),
        f"{out}_confidence": F.when(both & same, F.greatest(c, dbl(0.9))).when(both, c * dbl(0.8)).when(inside(a), c).when(inside(b), dbl(0.6)).otherwise(dbl(0)),
        "label_source": F.when(both & same, "llm+rule_agree").when(both, "llm+rule_disagree").when(inside(a), "llm_only").when(inside(b), "rule_only").otherwise("none"),
    })


def hybrid(pre: DataFrame, sentences: DataFrame, key: str = "sent_id", **kw) -> DataFrame:
    """Pre-labels joined to their sentences; repeated keys multiply rows."""
    return reconcile(pre.join(sentences, key, "left"), **kw)


def agreement(df: DataFrame) -> DataFrame:
    """label_source, n, pct of the labelled rows."""
    g = df.groupBy("label_source").agg(F.count("*").alias("n"))
    labelled = F.sum(F.when(F.col("label_source") != "none", F.col("n")).otherwise(0)).over(W.partitionBy())
    return g.withColumn("pct", F.col("n") / F.greatest(labelled, F.lit(1)) * 100)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, raw_agreement, kappa over rows where both are there."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = pairs.groupBy("x").agg(F.sum("n").alias("r")), pairs.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "x").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"))
    t = total.join(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("rc", dbl(0)) / F.col("n") / F.col("n")
    return t.select(F.coalesce("n", F.lit(0)).alias("n"), po.alias("raw_agreement"), F.when(pe == 1, dbl(1)).otherwise((po - pe) / (dbl(1) - pe)).alias("kappa"))


def confident(df: DataFrame, out: str = "topic", least: float = 0.5) -> DataFrame:
    helpers = [c for c in ("llm_label", "llm_confidence", "llm_reason", "rule_label", "rule_confidence", "rule_source") if c in df.columns]
    return kept(df, F.col(f"{out}_confidence") >= dbl(least)).drop(*helpers)


def stratified_split(df: DataFrame, label: str, key: str, shares=(0.8, 0.1, 0.1), seed: int = 42, names=("train", "val", "test")) -> DataFrame:
    """Adds split: each label's rows, ordered by a seeded hash of the key, are cut at the shares.

    A label's rows are counted by the hash's first digits, and only ordered within these, so that no task gets a label's."""
    of, part, part2, label2, before, all_ = free([*df.columns, "split"], "hash", "part", "part2", "label2", "before", "all")
    d = df.withColumn(of, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn(part, F.substring(of, 1, 3))
    counts = d.groupBy(F.col(label).alias(label2), F.col(part).alias(part2)).agg(F.count("*").alias(all_))  # 4096 rows a label
    so_far = W.partitionBy(label2).orderBy(part2).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumns({before: F.coalesce(F.sum(all_).over(so_far), F.lit(0)), all_: F.sum(all_).over(W.partitionBy(label2))})
    place = F.row_number().over(W.partitionBy(label, part).orderBy(of, key))
    d = d.withColumn(of, place).join(counts, F.col(label).eqNullSafe(F.col(label2)) & (F.col(part) == F.col(part2)))
    n, r = F.col(all_), F.col(before) + F.col(of)
    out, at = F, 0.0
    for name, share in zip(names[:-1], shares[:-1], strict=True):
        at += share
        out = out.when(r <= F.round(n * dbl(at)), name)
    return d.withColumn("split", out.otherwise(names[-1])).select(*(c for c in df.columns if c != "split"), "split")


def esg_subset(df: DataFrame) -> DataFrame:
    """Rows whose topic isn't Non_ESG; null topics stay."""
    return kept(df, ~F.col("topic_label").eqNullSafe("Non_ESG"))


def action_subset(df: DataFrame) -> DataFrame:
    return kept(df, F.col("action_label").isin(*ACTIONS))


def encode(df: DataFrame, label: str, labels) -> DataFrame:
    """Adds label_id; rows with other labels go."""
    ids = F.create_map(*(x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))))
    return kept(df.withColumn("label_id", F.try_element_at(ids, F.col(label))), F.col("label_id").isNotNull())


def class_weights(df: DataFrame, label: str, labels, method: str = "inverse", beta: float = 0.9999) -> DataFrame:
    """label, n, weight; the weights sum to the number of classes."""
    spark: SparkSession = df.sparkSession
    all_ = spark.createDataFrame([(k,) for k in labels], "label string")
    n = settled(df.select(F.col(label).alias("__label")), F.col("__label").alias("label")).where(F.col("label").isin(*labels)).groupBy("label").agg(F.count("*").alias("n"))
    w = all_.join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c, total = F.greatest("n", F.lit(1)), F.sum("n").over(W.partitionBy())
    raw = {
        "inverse": total / (len(labels) * c), "sqrt_inverse": F.sqrt(total / (len(labels) * c)), "effective": dbl(1 - beta) / (dbl(1) - F.pow(dbl(beta), c.cast("double"))),
    }.get(method, dbl(1))
    w = w.withColumn("raw", raw)
    return w.select("label", "n", (F.col("raw") / F.sum("raw").over(W.partitionBy()) * len(labels)).alias("weight"))


def f1_report(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where undefined."""
    by = list(by)
    cells = df.groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    tall = cells.select(*by, "n", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("x"), (F.col("t") == F.col("p")).alias("ok"))
    g = tall.groupBy(*by, F.col("x.label").alias("label")).agg(
        F.sum(F.when((F.col("x.side") == "t") & F.col("ok"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(dbl(0))
    return g.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
    })


def f1_summary(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """macro_f1 and micro_f1."""
    r = f1_report(df, truth, predicted, by)
    micro = F.when(F.sum(F.col("predicted") + F.col("support")) > 0, 2 * F.sum("tp") / F.sum(F.col("predicted") + F.col("support"))).otherwise(dbl(0))
    return r.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), micro.alias("micro_f1"))
