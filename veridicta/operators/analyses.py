"""Analyses of (bank, year) scores and of scored sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import correlation, dbl, entropy, rate
from veridicta.functions.packs import ACTIONS, ESG_TOPICS
from veridicta.operators.risk import level, sentence_risks, washing_risk
from veridicta.plans.lineage import checkpointed, settled, sums_before

ES_BINS = (("None (0)", 0.0, 0.1), ("Low (0-0.3)", 0.1, 0.3), ("Medium (0.3-0.6)", 0.3, 0.6), ("High (0.6+)", 0.6, 1.01))
EVIDENCE_TYPES = ("KPI", "Standard", "Time_bound", "Third_party")
CORRELATED = ("ewri", "ewri_old", "evidence_ratio", "avg_evidence_strength", "implemented_ratio", "indeterminate_ratio", "topic_entropy", "total_sentences")


def _moments(c: str, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]


def _max(a: Column, b: float) -> Column:
    return F.greatest(a, dbl(b))


def decomposition(scores: DataFrame) -> DataFrame:
    """component, mean_contribution, pct_of_ewri, std, with the EWRI's own moments."""
    cols = [("Indeterminate", "contrib_indeterminate"), ("Planning", "contrib_planning"), ("Implemented", "contrib_implemented")]
    one = scores.agg(*_moments("ewri", "ewri"), *(x for k, c in cols for x in (F.avg(c).alias(f"m_{k}"), F.stddev_samp(c).alias(f"s_{k}"))))
    base = F.when(F.col("ewri_mean") < 1e-6, dbl(1)).otherwise(F.col("ewri_mean"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("component"), F.col(f"m_{k}").alias("m"), F.col(f"s_{k}").alias("s")) for k, _ in cols)))
    return one.withColumn("b", base).select("b", "ewri_mean", "ewri_std", "ewri_min", "ewri_max", rows.alias("x")).select(
        "x.component", F.col("x.m").alias("mean_contribution"), (F.col("x.m") / F.col("b") * 100).alias("pct_of_ewri"), F.col("x.s").alias("std"), "ewri_mean", "ewri_std", "ewri_min", "ewri_max"
    )


def strength_bin(c: Column) -> Column:
    out = F
    for name, low, high in ES_BINS:
        out = out.when((c >= dbl(low)) & (c < dbl(high)), name)
    return out.otherwise(F.lit(None).cast("string"))


def action_evidence(df: DataFrame) -> DataFrame:
    """Every action with every bin of evidence strength, empty cells too."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b[0]) for a in ACTIONS for b in ES_BINS], "action_label string, es_level string")
    cells = df.withColumn("es_level", strength_bin(F.col("es_combined"))).groupBy("action_label", "es_level").agg(F.count("*").alias("n"), F.avg("wrs").alias("avg_wrs"), F.avg("es_combined").alias("avg_es"))
    total = df.agg(F.count("*").alias("total"))
    out = grid.join(cells, ["action_label", "es_level"], "left").join(total)  # one row
    return out.select("action_label", "es_level", F.coalesce("n", F.lit(0)).alias("count"), (F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)) * 100).alias("pct_of_total"), "avg_wrs", "avg_es")


ES_STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)


def theoretical_risk(spark: SparkSession) -> DataFrame:
    rows = [(a, e) for a in ACTIONS for e in ES_STEPS]
    return spark.createDataFrame(rows, "action_label string, es double").withColumn("wrs", washing_risk(F.col("action_label"), F.col("es")))


def theory_and_sentences(df: DataFrame) -> DataFrame:
    """The formula's risk at each step of evidence strength, beside the number of sentences nearest to the step and their
    mean risk; steps without sentences have 0 and null."""
    near = F.round(F.round("es_combined", 9) * (len(ES_STEPS) - 1)) / (len(ES_STEPS) - 1)
    seen = df.groupBy("action_label", near.alias("es")).agg(F.count("*").alias("n"), F.avg("wrs").alias("avg_wrs"))
    return theoretical_risk(df.sparkSession).join(F.broadcast(seen), ["action_label", "es"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a row a step


def topic_summary(df: DataFrame, least: int = 5) -> DataFrame:
    act = lambda a: rate(F.col("action_label") == a) * 100
    got = df.groupBy(F.col("topic_label").alias("topic")).agg(
        F.count("*").alias("n"), (F.avg("wrs") * 100).alias("e"), *(act(a).alias(a) for a in ACTIONS), (rate(F.col("has_evidence")) * 100).alias("v"), F.avg("es_combined").alias("s")
    )
    topics = df.sparkSession.createDataFrame([(t,) for t in ESG_TOPICS], "topic string")
    total = df.agg(F.count("*").alias("total"))
    out = topics.join(got, "topic", "left").join(total).withColumn("n", F.coalesce("n", F.lit(0)))  # one row
    ok = F.col("n") >= least
    w = lambda c, name: F.when(ok, c).alias(name)
    return out.select(
        "topic", "n", w(F.col("n") / F.col("total") * 100, "pct_of_corpus"), w(F.col("e"), "ewri"), w(level(F.col("e")), "risk_level"), w(F.col("Implemented"), "implemented_pct"),
        w(F.col("Planning"), "planning_pct"), w(F.col("Indeterminate"), "indeterminate_pct"), w(F.col("v"), "evidence_rate"), w(F.col("s"), "avg_evidence_strength"),
    )


def bank_topics(df: DataFrame) -> DataFrame:
    """Topic counts, their entropy and the first of the largest, for each bank."""
    g = df.where("bank IS NOT NULL").groupBy("bank").agg(*(F.count_if(F.col("topic_label") == t).alias(f"n_{t}") for t in ESG_TOPICS))
    counts = [F.col(f"n_{t}") for t in ESG_TOPICS]
    top, dominant = F.greatest(*counts), F
    for t in ESG_TOPICS:
        dominant = dominant.when((F.col(f"n_{t}") == top) & (top > 0), t)
    return g.withColumns({"entropy": entropy(counts), "dominant_topic": dominant.otherwise("N/A")})


def topic_actions(df: DataFrame) -> DataFrame:
    d = settled(df, F.col("topic_label").alias("topic")).where(F.col("topic").isin(*ESG_TOPICS))
    return d.groupBy("topic").agg(*((rate(F.col("action_label") == a) * 100).alias(f"{a.lower()}_pct") for a in ACTIONS))


def yearly(scores: DataFrame) -> DataFrame:
    return scores.groupBy("year").agg(
        *_moments("ewri", "ewri"), F.avg("ewri_old").alias("ewri_old_mean"), F.avg("evidence_ratio").alias("evidence_ratio"), F.avg("avg_evidence_strength").alias("avg_es"),
        F.avg("implemented_ratio").alias("impl_ratio"), F.avg("topic_entropy").alias("topic_entropy"),
    )


def bank_trends(scores: DataFrame) -> DataFrame:
    g = scores.groupBy("bank").agg(F.array_sort(F.collect_list(F.struct("year", "ewri"))).alias("s"), F.count("*").alias("n"))  # a few years a bank
    change = F.when(F.col("n") >= 2, F.element_at("s", -1)["ewri"] - F.col("s")[0]["ewri"]).otherwise(dbl(0))
    trend = F.when(F.col("n") < 2, "insufficient_data").when(change < -2, "improving").when(change > 2, "worsening").otherwise("stable")
    return g.select("bank", F.col("s.year").alias("years"), F.col("s.ewri").alias("ewri_values"), change.alias("ewri_change"), trend.alias("trend"))


def ranking(scores: DataFrame) -> DataFrame:
    g = scores.groupBy("bank").agg(
        *_moments("ewri", "ewri"), F.avg("ewri_old").alias("ewri_old_mean"), F.sum("total_sentences").alias("total_sentences"), F.avg("implemented_ratio").alias("impl_ratio"),
        F.avg("planning_ratio").alias("plan_ratio"), F.avg("indeterminate_ratio").alias("indet_ratio"), F.avg("evidence_ratio").alias("ev_ratio"),
        F.avg("avg_evidence_strength").alias("avg_es"), F.avg("topic_entropy").alias("topic_entropy"),
    )
    return g.withColumn("rank", F.row_number().over(W.orderBy("ewri_mean", "bank")))  # one row a bank


def profiles(scores: DataFrame) -> DataFrame:
    """Strengths and weaknesses against the banks' means."""
    r = ranking(scores)
    means = r.agg(F.avg("ewri_mean").alias("m_e"), F.avg("ev_ratio").alias("m_v"), F.avg("impl_ratio").alias("m_i"))
    d = r.join(means)  # one row
    c = F.col
    strengths = [
        (c("ewri_mean") < c("m_e") - 2, "Lower-than-average washing risk"), (c("ev_ratio") > c("m_v") + 0.05, "Better evidence coverage"),
        (c("impl_ratio") > c("m_i") + 0.05, "Higher implementation ratio"), (c("topic_entropy") > dbl(0.85), "Good topic coverage (diverse ESG reporting)"),
    ]
    weaknesses = [
        (c("ewri_mean") > c("m_e") + 2, "Higher-than-average washing risk"), (c("ev_ratio") < c("m_v") - 0.05, "Weak evidence coverage"), (c("impl_ratio") < c("m_i") - 0.05, "Low implementation ratio"),
        (c("indet_ratio") > dbl(0.65), "High proportion of vague claims (>65%)"), (c("topic_entropy") < dbl(0.65), "Poor topic coverage (concentrated reporting)"),
    ]
    pick = lambda rules: F.array_compact(F.array(*(F.when(k, t) for k, t in rules)))
    return d.select("bank", "rank", "ewri_mean", level(c("ewri_mean")).alias("risk_level"), "total_sentences", pick(strengths).alias("strengths"), pick(weaknesses).alias("weaknesses"))


def average_ranks(df: DataFrame, column: str, times: str | None = None) -> DataFrame:
    """value, n, rank: ranks of distinct values, ties at their mean; counted by ranges of values.  ``times``: how often a
    row counts."""
    count = F.count("*") if times is None else F.sum(times)
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(count.alias("n"))
    return sums_before(n, "n", "below", "value").select("value", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x, y, rho for each pair of columns; rows with nulls in either are left out by pair.  The rows are read once a pair:
    ranks and their correlation come from the counts of distinct pairs of values."""
    out = None
    for x, y in pairs:
        d = settled(df, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
        d = checkpointed(d.groupBy(F.col("__x").alias("x"), F.col("__y").alias("y")).agg(F.count("*").alias("n")))
        rx, ry = average_ranks(d, "x", "n").select(F.col("value").alias("x"), F.col("rank").alias("rx")), average_ranks(d, "y", "n").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
        mean = d.agg(((F.sum("n") + 1) / 2).alias("mean"))  # of either's ranks, one row
        a, b, n = F.col("rx") - F.col("mean"), F.col("ry") - F.col("mean"), F.col("n")
        spread = F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b))
        one = d.join(rx, "x").join(ry, "y").join(mean).agg(F.when(spread > 0, F.sum(n * a * b) / spread).alias("rho")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "rho")
        out = one if out is None else out.unionByName(one)
    return out


def spearman_matrix(scores: DataFrame, columns=CORRELATED) -> DataFrame:
    """All pairs at once: ranks beside the values, one row a (bank, year)."""
    d = scores
    for c in columns:
        n = F.count("*").over(W.partitionBy(c))
        d = d.withColumn(f"r_{c}", F.rank().over(W.orderBy(c)) + (n - 1) / 2)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = d.agg(*(correlation(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("rho")) for a, b in pairs)))
    return one.select(rows.alias("r")).select("r.x", "r.y", "r.rho")


def eta_squared(df: DataFrame, group: str = "action_label", value: str = "wrs") -> DataFrame:
    """Share of the variance that lies between groups, from each group's count, mean and squares."""
    g = settled(df, F.col(group).alias("__g"), F.col(value).alias("__v")).where("__g IS NOT NULL AND __v IS NOT NULL").groupBy("__g").agg(F.count("*").alias("n"), F.avg("__v").alias("m"), F.var_pop("__v").alias("v"))
    t = g.withColumn("mu", F.sum(F.col("n") * F.col("m")).over(W.partitionBy()) / F.sum("n").over(W.partitionBy()))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), 2))
    total = between + F.sum(F.col("n") * F.col("v"))
    return t.agg(F.when(total > 0, between / total).otherwise(dbl(0)).alias("eta_squared"))


def compare_formulas(scores: DataFrame) -> DataFrame:
    """formula, mean, std, iqr, range, cv for the additive (old) and the interaction (new) index."""
    out = None
    for name, c in (("old", "ewri_old"), ("new", "ewri")):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
        one = scores.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), (q[1] - q[0]).alias("iqr"), (F.max(c) - F.min(c)).alias("range"))
        one = one.select(F.lit(name).alias("formula"), "mean", "std", "iqr", "range", (F.col("std") / _max(F.col("mean"), 0.01) * 100).alias("cv"))
        out = one if out is None else out.unionByName(one)
    return out


def improvements(scores: DataFrame) -> DataFrame:
    s = scores.agg(F.stddev_samp("ewri").alias("a"), F.stddev_samp("ewri_old").alias("b"), (F.max("ewri") - F.min("ewri")).alias("c"), (F.max("ewri_old") - F.min("ewri_old")).alias("d"))
    more = lambda new, old: (F.col(new) - F.col(old)) / _max(F.col(old), 0.01) * 100
    return s.select(more("a", "b").alias("std_improvement_pct"), more("c", "d").alias("range_improvement_pct"))


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Levels of the additive index (its rounded value) and of the interaction index (as stored)."""
    old = scores.groupBy(level(F.col("ewri_old")).alias("risk_level")).agg(F.count("*").alias("n")).withColumn("formula", F.lit("old"))
    new = scores.groupBy("risk_level").agg(F.count("*").alias("n")).withColumn("formula", F.lit("new"))
    return old.unionByName(new)


def evidence_importance(df: DataFrame) -> DataFrame:
    """Each type's count, share, and mean risk with and without it, in one pass."""
    has = {t: F.coalesce(F.array_contains("evidence_types", t), F.lit(False)) for t in EVIDENCE_TYPES}
    one = df.agg(F.count("*").alias("total"), *(x for t, h in has.items() for x in (F.count_if(h).alias(f"n_{t}"), F.avg(F.when(h, F.col("wrs"))).alias(f"w_{t}"), F.avg(F.when(~h, F.col("wrs"))).alias(f"o_{t}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.col(f"n_{t}").alias("n"), F.col(f"w_{t}").alias("w"), F.col(f"o_{t}").alias("o")) for t in EVIDENCE_TYPES)))
    x = one.select("total", rows.alias("r")).select("total", "r.*")
    return x.select(
        "type", F.col("n").alias("count"), (F.col("n") / F.greatest("total", F.lit(1)) * 100).alias("frequency_pct"), F.col("w").alias("avg_wrs_present"), F.col("o").alias("avg_wrs_absent"),
        ((F.col("o") - F.col("w")) / _max(F.col("o"), 0.001) * 100).alias("risk_reduction_pct"),
    )


def cooccurrence(df: DataFrame) -> DataFrame:
    names = sorted(EVIDENCE_TYPES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b: F.coalesce(F.array_contains("evidence_types", a) & F.array_contains("evidence_types", b), F.lit(False))
    one = df.agg(*(F.count_if(both(a, b)).alias(f"{a}+{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(f"{a}+{b}").alias("pair"), F.col(f"`{a}+{b}`").alias("count")) for a, b in pairs)))
    return one.select(rows.alias("r")).select("r.pair", "r.count")


def qualitative_samples(df: DataFrame, n: int = 5, order: str = "sent_pos") -> DataFrame:
    """Four kinds of examples: the 3n of highest (substantive ones: lowest) risk, of these the ones longer than 30
    characters, of these the first n.  No sentence is of two kinds, so one pass finds all."""
    act, es, low = F.col("action_label"), F.col("es_combined"), "low_risk_substantive"
    kinds = {
        "high_risk_pure_washing": (act == "Indeterminate") & ~F.col("has_evidence"), "suspicious_unsubstantiated": (act == "Implemented") & (es < dbl(0.15)),
        "medium_risk_planning": (act == "Planning") & (es > dbl(0.1)) & (es < dbl(0.5)), low: (act == "Implemented") & (es > dbl(0.4)),
    }
    kind = F
    for name, rule in kinds.items():
        kind = kind.when(rule, name)
    d = settled(df, kind.alias("kind")).where("kind IS NOT NULL")
    lowest, highest = F.when(F.col("kind") == low, F.col("wrs")).asc(), F.when(F.col("kind") != low, F.col("wrs")).desc()
    top = d.withColumn("a", F.row_number().over(W.partitionBy("kind").orderBy(lowest, highest, order))).where(F.col("a") <= 3 * n)  # each task keeps 3n rows a kind
    got = top.where(F.length("sentence") > 30).withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy("a"))).where(F.col("rank") <= n)
    return got.select("kind", "rank", F.substring("sentence", 1, 300).alias("sentence"), "bank", "year", "action_label", es.alias("evidence_strength"), F.col("wrs").alias("washing_risk"), "has_evidence", "evidence_types", F.col("topic_label").alias("topic"))


def noise_rate(df: DataFrame, groups: int = 10, top: int = 10, order: str = "sent_pos") -> DataFrame:
    """Share of short claims among the first groups' top claims; the groups in the order of bank and year."""
    first = df.where("bank IS NOT NULL AND year IS NOT NULL").select("bank", "year").distinct().orderBy("bank", "year").limit(groups)
    claims = sentence_risks(df.join(first, ["bank", "year"], "left_semi"), order, top)
    bad = (F.length("sentence") < 30) | (F.length("sentence") - F.length(F.replace("sentence", F.lit(" "))) < 3)
    return claims.agg(F.count("*").alias("top_claims_checked"), F.count_if(bad).alias("noise_count"), (F.count_if(bad) / F.greatest(F.count("*"), F.lit(1)) * 100).alias("noise_rate_pct"))


def run_all(df: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """Every analysis by name; ``scores`` are the rounded (bank, year) rows."""
    return {
        "ewri_decomposition": decomposition(scores), "action_evidence_matrix": action_evidence(df), "theoretical_matrix": theoretical_risk(df.sparkSession), "topic_summary": topic_summary(df),
        "bank_topic_distribution": bank_topics(df), "topic_action_distribution": topic_actions(df), "temporal_trends": yearly(scores), "bank_trends": bank_trends(scores), "bank_ranking": ranking(scores),
        "bank_profiles": profiles(scores), "correlations": spearman_matrix(scores), "sentence_correlations": spearman(df, [("wrs", "es_combined"), ("wrs", "has_evidence")]), "eta_squared": eta_squared(df),
        "formula_comparison": compare_formulas(scores), "formula_improvement": improvements(scores), "risk_distribution": risk_distribution(scores), "evidence_type_importance": evidence_importance(df),
        "evidence_cooccurrence": cooccurrence(df), "qualitative_samples": qualitative_samples(df), "quality_check": noise_rate(df),
    }
