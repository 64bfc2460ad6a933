"""Evidence strength, washing risk, and their roll-up to (bank, year)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import clamp, correlation, dbl, entropy
from veridicta.functions.packs import ACTIONS, ESG_TOPICS, EVIDENCE
from veridicta.operators.evidence import quality

# Fixed values.
PENALTY = {"Implemented": 0.08, "Planning": 0.30, "Indeterminate": 0.55}
SENSITIVITY = {"Implemented": 0.80, "Planning": 0.65, "Indeterminate": 0.50}
W_QUALITY, W_SIMILARITY, W_NLI = 0.35, 0.35, 0.30
CONTRADICTION = 1.3
LEVELS = (25.0, 38.0, 43.0)
LEGACY_LEVELS = (30.0, 50.0, 70.0)
ALPHA, BETA, GAMMA = 2.0, 1.0, 1.0


def _of(table: dict[str, float], action: Column, default: float) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(action == k, dbl(v))
    return out.otherwise(dbl(default))


def calibrated(similarity: Column, mean: Column, std: Column) -> Column:
    """Standing in its document; a spread of exactly 0 counts as 0.1, one up to 0.01 leaves the raw value."""
    std = F.when(std == 0, dbl(0.1)).otherwise(std)
    return F.when(std > dbl(0.01), clamp((similarity - mean) / (dbl(2) * std))).otherwise(clamp(similarity))


def evidence_strength(types: Column, similarity: Column, nli_label: Column, entailment: Column, pack=EVIDENCE) -> Column:
    nli = F.when(nli_label == "entailment", entailment).otherwise(dbl(0))
    return clamp(dbl(W_QUALITY) * quality(types, pack) + dbl(W_SIMILARITY) * similarity + dbl(W_NLI) * nli)


def washing_risk(action: Column, strength: Column, nli_label: Column | None = None) -> Column:
    base = _of(PENALTY, action, 0.55) * (dbl(1) - _of(SENSITIVITY, action, 0.50) * strength)
    if nli_label is not None:
        base = F.when(nli_label == "contradiction", F.least(base * dbl(CONTRADICTION), dbl(1))).otherwise(base)
    return clamp(base)


def additive_risk(action: Column, strength: Column) -> Column:
    act = F.when(action == "Indeterminate", dbl(ALPHA)).when(action == "Planning", dbl(BETA)).otherwise(dbl(0))
    return (act + dbl(GAMMA) * (dbl(1) - strength)) / dbl(ALPHA + BETA + GAMMA)


def level(ewri: Column, cuts=LEVELS) -> Column:
    a, b, c = cuts
    return F.when(ewri < dbl(a), "Low").when(ewri < dbl(b), "Medium").when(ewri < dbl(c), "High").otherwise("Very High")


def enrich(df: DataFrame, pack=EVIDENCE) -> DataFrame:
    """Adds sim_doc_mean, sim_doc_std, es_combined, wrs, wrs_old."""
    if "similarity_score" in df.columns and "bank" in df.columns:
        # two small partial sums a document, joined back: no window over all of a document's rows
        stats = df.where("bank IS NOT NULL AND year IS NOT NULL").groupBy("bank", "year").agg(F.avg("similarity_score").alias("m"), F.stddev_samp("similarity_score").alias("s"))
        df = df.join(stats, ["bank", "year"], "left").withColumns({"sim_doc_mean": F.coalesce("m", dbl(0)), "sim_doc_std": F.coalesce("s", dbl(0.1))}).drop("m", "s")
    else:
        df = df.withColumns({"sim_doc_mean": dbl(0), "sim_doc_std": dbl(0.1)})
    for name, value in (("similarity_score", dbl(0)), ("nli_label", F.lit("")), ("nli_entailment_score", dbl(0))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    similarity = calibrated(F.coalesce("similarity_score", dbl(0)), F.col("sim_doc_mean"), F.col("sim_doc_std"))
    df = df.withColumn("es_combined", evidence_strength(F.col("evidence_types"), similarity, F.col("nli_label"), F.coalesce("nli_entailment_score", dbl(0)), pack))
    action, strength = F.col("action_label"), F.col("es_combined")
    return df.withColumns({"wrs": washing_risk(action, strength, F.col("nli_label")), "wrs_old": additive_risk(action, strength)})


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def bank_years(df: DataFrame) -> DataFrame:
    """One row for each (bank, year), unrounded; ``rounded`` gives the published precision."""
    if "wrs" not in df.columns:
        df = enrich(df)
    df = df.where("bank IS NOT NULL AND year IS NOT NULL")
    act = lambda a: F.col("action_label") == a
    topic = F.col("topic_label") if "topic_label" in df.columns else F.lit(None).cast("string")
    evidence = F.col("has_evidence") if "has_evidence" in df.columns else F.lit(False)
    part = lambda a: F.sum(F.when(act(a), F.col("wrs")).otherwise(dbl(0))) / F.count("*") * dbl(100)
    g = df.groupBy("bank", "year").agg(
        F.count("*").alias("total_sentences"),
        *(_n(act(a)).alias(a.lower()) for a in ACTIONS),
        _n(evidence).alias("with_evidence"),
        F.avg("es_combined").alias("avg_evidence_strength"),
        (F.avg("wrs") * dbl(100)).alias("ewri"),
        (F.avg("wrs_old") * dbl(100)).alias("ewri_old"),
        *(part(a).alias(f"contrib_{a.lower()}") for a in ACTIONS),
        *(_n(topic == t).alias(f"n_{t}") for t in ESG_TOPICS),
    )
    share = lambda c: F.col(c) / F.col("total_sentences")
    g = g.withColumns({
        "without_evidence": F.col("total_sentences") - F.col("with_evidence"),
        **{f"{a.lower()}_ratio": share(a.lower()) for a in ACTIONS},
        "evidence_ratio": share("with_evidence"),
        "risk_level": level(F.col("ewri")),
        "topic_entropy": entropy([F.col(f"n_{t}") for t in ESG_TOPICS]),
    })
    return g.withColumn("topic_coverage_index", dbl(1) - F.col("topic_entropy"))


SCORE_COLUMNS = (
    "bank", "year", "total_sentences", "implemented", "planning", "indeterminate", "with_evidence", "without_evidence", "implemented_ratio", "planning_ratio", "indeterminate_ratio",
    "evidence_ratio", "avg_evidence_strength", "ewri", "ewri_old", "risk_level", "contrib_implemented", "contrib_planning", "contrib_indeterminate", "topic_entropy", "topic_coverage_index",
)
_TWO = ("ewri", "ewri_old", "contrib_implemented", "contrib_planning", "contrib_indeterminate")
_THREE = ("implemented_ratio", "planning_ratio", "indeterminate_ratio", "evidence_ratio", "avg_evidence_strength", "topic_entropy", "topic_coverage_index")


def rounded(scores: DataFrame) -> DataFrame:
    """The 21 columns at published precision, best first by EWRI descending."""
    scores = scores.withColumns({c: F.round(c, 2) for c in _TWO} | {c: F.round(c, 3) for c in _THREE})
    return scores.select(*SCORE_COLUMNS)


def topic_breakdown(df: DataFrame, least: int = 3) -> DataFrame:
    """Each (bank, year) with each of the five topics; under ``least`` sentences without figures."""
    d = df.where("bank IS NOT NULL AND year IS NOT NULL")
    is_ = lambda a: F.when(F.col("action_label") == a, 1.0).otherwise(0.0)
    got = d.groupBy("bank", "year", F.col("topic_label").alias("topic")).agg(
        F.count("*").alias("n"), (F.avg("wrs") * 100).alias("e"), (F.avg(is_("Implemented")) * 100).alias("i"), (F.avg(is_("Indeterminate")) * 100).alias("d"),
        (F.avg(F.when(F.col("has_evidence"), 1.0).otherwise(0.0)) * 100).alias("v"),
    )
    grid = d.select("bank", "year").distinct().withColumn("topic", F.explode(F.array(*map(F.lit, ESG_TOPICS))))
    out = grid.join(got, ["bank", "year", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    return out.select(
        "bank", "year", "topic", "n", F.when(enough, F.col("e")).alias("ewri"), F.when(enough, level(F.col("e"))).otherwise("N/A").alias("risk_level"),
        F.when(enough, F.col("i")).alias("implemented_pct"), F.when(enough, F.col("d")).alias("indeterminate_pct"), F.when(enough, F.col("v")).alias("evidence_rate"),
    )


def sentence_risks(df: DataFrame, order: str = "sent_pos", top: int | None = None) -> DataFrame:
    """Sentences of each (bank, year) by falling rounded risk; equal ones in their order."""
    risk = F.round("wrs", 3)
    d = df.where("bank IS NOT NULL AND year IS NOT NULL").select(
        "bank", "year", "sent_id", F.substring(F.coalesce("sentence", F.lit("")), 1, 250).alias("sentence"), "action_label", F.round("action_confidence", 3).alias("action_confidence"),
        "has_evidence", F.round("es_combined", 3).alias("evidence_strength"), risk.alias("washing_risk"), F.col("topic_label").alias("topic"), "evidence_types", "nli_label",
        F.substring(F.coalesce("best_evidence", F.lit("")), 1, 200).alias("best_evidence"), order,
    )
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("bank", "year").orderBy(F.col("washing_risk").desc(), order)))
    return d if top is None else d.where(F.col("rank") <= top)


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("n"), F.min("ewri").alias("ewri_min"), F.max("ewri").alias("ewri_max"), F.avg("ewri").alias("ewri_mean"), F.stddev_samp("ewri").alias("ewri_std"),
        F.avg("ewri_old").alias("ewri_old_mean"), correlation("ewri", "ewri_old").alias("pearson"),
    )


# the first formula, on evidence strength that defaults to the flag


def legacy_strength(df: DataFrame) -> DataFrame:
    flag = F.when(F.col("has_evidence"), dbl(1)).otherwise(dbl(0))
    return df if "evidence_strength" in df.columns else df.withColumn("evidence_strength", flag)


def legacy_topic_column(df: DataFrame) -> str | None:
    return next((c for c in ("topic_label", "topic", "topic_pred") if c in df.columns), None)


def legacy_bank_years(df: DataFrame) -> DataFrame:
    d = legacy_strength(df).where("bank IS NOT NULL AND year IS NOT NULL")
    g = d.groupBy("bank", "year").agg(
        F.count("*").alias("total_sentences"), *(_n(F.col("action_label") == a).alias(a.lower()) for a in ACTIONS), _n(F.col("has_evidence")).alias("with_evidence"),
        (F.avg(additive_risk(F.col("action_label"), F.col("evidence_strength"))) * dbl(100)).alias("ewri"),
    )
    n = F.col("total_sentences")
    return g.withColumns({
        "without_evidence": n - F.col("with_evidence"), "symbolic_ratio": F.col("indeterminate") / n, "evidence_ratio": F.col("with_evidence") / n,
        "substantive_ratio": F.col("implemented") / n, "risk_level": level(F.col("ewri"), LEGACY_LEVELS),
    })


def legacy_topics(df: DataFrame, least: int = 3) -> DataFrame:
    topic = legacy_topic_column(df)
    d = legacy_strength(df).where("bank IS NOT NULL AND year IS NOT NULL")
    got = d.groupBy("bank", "year", F.col(topic).alias("topic")).agg(F.count("*").alias("n"), (F.avg(additive_risk(F.col("action_label"), F.col("evidence_strength"))) * dbl(100)).alias("e"))
    grid = d.select("bank", "year").distinct().withColumn("topic", F.explode(F.array(*map(F.lit, ESG_TOPICS))))
    out = grid.join(got, ["bank", "year", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    return out.select("bank", "year", "topic", "n", F.when(enough, F.col("e")).alias("ewri"), F.when(enough, level(F.col("e"), LEGACY_LEVELS)).otherwise("N/A").alias("risk_level"))


def legacy_claims(df: DataFrame, order: str = "sent_pos") -> DataFrame:
    d = legacy_strength(df)
    risk = F.round(additive_risk(F.col("action_label"), F.col("evidence_strength")) * dbl(100), 2)
    text = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n) if c in d.columns else F.lit("")
    return d.where("bank IS NOT NULL AND year IS NOT NULL").select(
        "bank", "year", "sent_id", text("sentence", 200).alias("sentence"), "action_label", "has_evidence", F.round("evidence_strength", 3).alias("evidence_strength"), risk.alias("risk_score"),
        text("action_explanation", 300).alias("explanation"), F.col(legacy_topic_column(d) or "sent_id").alias("topic"), text("section_title", 1000).alias("section"), order,
    )


def legacy_top_claims(df: DataFrame, top: int = 10, order: str = "sent_pos") -> DataFrame:
    best = W.partitionBy("bank", "year").orderBy(F.col("risk_score").desc(), order)
    return legacy_claims(df, order).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
