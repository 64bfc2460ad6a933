import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridicta.functions.expressions import entropy
from veridicta.operators import analyses, labels, linking, risk

ROWS = [
    ("a", 2020, "Implemented", ["KPI"], 0.8, "entailment", 0.9, 0.565941, 0.043780, 0.108515),
    ("a", 2020, "Indeterminate", [], 0.5, "contradiction", 0.25, 0.0, 0.715000, 0.750000),
    ("a", 2020, "Planning", ["Standard", "Time_bound"], 0.6, "neutral", 0.4, 0.122500, 0.276112, 0.469375),
    ("b", 2021, "Indeterminate", [], 0.7, "neutral", 0.5, 0.0, 0.550000, 0.750000),
    ("c", 2022, "Implemented", ["KPI", "Time_bound"], 0.5, "neutral", 0.5, 0.157500, 0.069920, 0.210625),
    ("c", 2022, "Unknown", [], 0.5, "entailment", 1.0, 0.300000, 0.467500, 0.175000),
]
SCHEMA = "bank string, year int, action_label string, evidence_types array<string>, similarity_score double, nli_label string, nli_entailment_score double, i int"


def frame(spark):
    df = spark.createDataFrame([(*r[:7], i) for i, r in enumerate(ROWS)], SCHEMA)
    return df.withColumns({"has_evidence": F.size("evidence_types") > 0, "topic_label": F.lit("E"), "sent_id": F.col("i").cast("string"), "sentence": F.lit("one two three four"), "sent_pos": F.col("i")})


def test_fixture(spark):
    got = {r["i"]: r for r in risk.enrich(frame(spark)).collect()}
    for i, r in enumerate(ROWS):
        assert [round(got[i][c], 6) for c in ("es_combined", "wrs", "wrs_old")] == pytest.approx(r[7:], abs=1.1e-6), i


def test_roll_up(spark):
    s = risk.bank_years(risk.enrich(frame(spark)))
    for r in s.collect():
        assert r["contrib_implemented"] + r["contrib_planning"] + r["contrib_indeterminate"] <= r["ewri"] + 1e-9
        assert r["implemented"] + r["planning"] + r["indeterminate"] <= r["total_sentences"]
    assert risk.rounded(s).columns == list(risk.SCORE_COLUMNS)
    assert analyses.ranking(s).count() == 3
    assert analyses.bank_trends(s).where("trend <> 'insufficient_data'").isEmpty()


@pytest.mark.parametrize("counts,expected", [((2, 1, 1, 0, 0), 0.946395), ((4, 0, 0, 0, 0), 0.0), ((1, 1, 1, 1, 1), 1.0), ((0, 0, 0, 0, 0), 0.0)])
def test_entropy(spark, counts, expected):
    r = spark.range(1).select(entropy([F.lit(c) for c in counts]).alias("e")).first()["e"]
    assert r == pytest.approx(expected, abs=1e-6)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["Implemented", "Planning", "Indeterminate", "x"]), st.floats(0, 1), st.sampled_from(["contradiction", "neutral", None])), min_size=1, max_size=30))
def test_risk_stays_in_range(spark, rows):
    df = spark.createDataFrame(rows, "a string, e double, n string")
    r = df.select(risk.washing_risk(F.col("a"), F.col("e"), F.col("n")).alias("w")).agg(F.min("w"), F.max("w")).first()
    assert 0 <= r[0] <= r[1] <= 1


def test_spearman_matches_ranks_by_hand(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (2.0, 1.0), (5.0, 0.0), (None, 1.0)], "x double, y double")
    r = analyses.spearman(df, [("x", "y")]).first()["rho"]
    a, b = [1, 2.5, 2.5, 4], [3.5, 3.5, 2, 1]
    ma, mb = sum(a) / 4, sum(b) / 4
    cov = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True))
    assert r == pytest.approx(cov / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)))


def seen(spark, kind="double"):
    """A function that gives values back, and a counter of how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, kind), calls


def test_spearman_reads_its_rows_once(spark):
    same, calls = seen(spark)
    df = spark.range(60).select(same(F.col("id") % 7 / 2).alias("x"), ((F.col("id") * 13) % 5).alias("y"), F.lit(1.5).alias("one"), F.lit(None).cast("double").alias("none"))
    got = analyses.spearman(df, [("x", "y")]).first()["rho"]
    assert calls.value == 60
    xs, ys = [i % 7 / 2 for i in range(60)], [i * 13 % 5 for i in range(60)]
    ranks = lambda v: [sum(b < a for b in v) + (v.count(a) + 1) / 2 for a in v]
    a, b = [r - 30.5 for r in ranks(xs)], [r - 30.5 for r in ranks(ys)]
    assert got == pytest.approx(sum(p * q for p, q in zip(a, b, strict=True)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b)))
    assert [(r["x"], r["y"], r["rho"]) for r in analyses.spearman(df, [("x", "one"), ("x", "none")]).collect()] == [("x", "one", None), ("x", "none", None)]


def test_samples_read_their_rows_once(spark):
    same, calls = seen(spark, "string")
    acts = ["Indeterminate", "Implemented", "Planning", "Unknown", None]
    rows = [(i, acts[i % 5], i % 3 == 0, i * 37 % 100 / 100, i * 11 % 7 / 7 if i % 9 else None, "s" * (20 + i % 29)) for i in range(400)]
    df = spark.createDataFrame(rows, "sent_pos int, action_label string, has_evidence boolean, es_combined double, wrs double, sentence string")
    df = df.withColumns({"action_label": same("action_label"), "bank": F.lit("b"), "year": F.lit(2020), "evidence_types": F.array(F.lit("KPI")), "topic_label": F.lit("E")})
    got = sorted((r["kind"], r["rank"], r["sentence"], r["washing_risk"], r["evidence_strength"]) for r in analyses.qualitative_samples(df).collect())
    assert calls.value == len(rows)
    kinds = {
        "high_risk_pure_washing": (lambda a, e, x: a == "Indeterminate" and not e, -1), "suspicious_unsubstantiated": (lambda a, e, x: a == "Implemented" and x < 0.15, -1),
        "medium_risk_planning": (lambda a, e, x: a == "Planning" and 0.1 < x < 0.5, -1), "low_risk_substantive": (lambda a, e, x: a == "Implemented" and x > 0.4, 1),
    }
    want = []
    for name, (rule, sign) in kinds.items():  # nulls are the smallest
        top = sorted((r for r in rows if rule(r[1], r[2], r[3])), key=lambda r: (sign * (-1 if r[4] is None else r[4]), r[0]))[:15]
        want += [(name, k, r[5], r[4], r[3]) for k, r in enumerate([r for r in top if len(r[5]) > 30][:5], 1)]
    assert got == sorted(want) and len({w[0] for w in want}) == 4


def test_filters_on_labels_compute_them_once(spark):
    topics, actions = ["E", "G", "Non_ESG", None], ["Implemented", "Planning", "Indeterminate"]
    rows = [(topics[i % 4], actions[i % 3]) for i in range(48)]
    for call in (
        lambda d: {r["topic"]: (round(r["implemented_pct"], 4), round(r["planning_pct"], 4)) for r in analyses.topic_actions(d).collect()} == {t: (33.3333, 33.3333) for t in ("E", "G")},
        lambda d: labels.esg_subset(d).collect().count(("G", "Planning")) == 4 and labels.esg_subset(d).columns == d.columns,
        lambda d: {(r[0], r[2]) for r in labels.encode(d, "topic_label", ("E", "G")).collect()} == {("E", 0), ("G", 1)},
        lambda d: {r["label"]: r["n"] for r in labels.class_weights(d, "topic_label", ("E", "G")).collect()} == {"E": 12, "G": 12},
        lambda d: analyses.eta_squared(d.withColumn("wrs", F.when(F.col("topic_label") == "E", 1.0).otherwise(0.0)), "topic_label").first()[0] == 1,
    ):
        same, calls = seen(spark, "string")
        assert call(spark.createDataFrame(rows, "topic_label string, action_label string").withColumn("topic_label", same("topic_label")))
        assert calls.value == 48


def test_kappa_and_reconciliation(spark):
    df = spark.createDataFrame([("E", 0.8, "E"), ("E", 0.8, "G"), (None, None, "G"), ("bad", 0.9, None), ("E", 0.4, None)], "llm_label string, llm_confidence double, rule_label string")
    got = [(r["topic_label"], round(r["topic_confidence"], 6), r["label_source"]) for r in labels.reconcile(df).collect()]
    assert got == [("E", 0.9, "llm+rule_agree"), ("E", 0.64, "llm+rule_disagree"), ("G", 0.6, "rule_only"), (None, 0.0, "none"), ("E", 0.4, "llm_only")]
    k = labels.kappa(spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0)], "a int, b int"), "a", "b").first()
    assert (k["n"], round(k["raw_agreement"], 6), round(k["kappa"], 6)) == (4, 0.75, 0.5)


def test_split_sizes(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(400)], "k int, l string")
    got = {(r["l"], r["split"]): r["count"] for r in labels.stratified_split(df, "l", "k").groupBy("l", "split").count().collect()}
    assert got == {("a", "train"): 240, ("a", "val"): 30, ("a", "test"): 30, ("b", "train"): 80, ("b", "val"): 10, ("b", "test"): 10}


def test_linking_by_hand(spark):
    vec = {0: [1.0, 0.0], 1: [1.0, 0.1], 2: [0.0, 1.0], 3: [0.0, 0.0]}
    df = spark.createDataFrame([("a", 2020, i, v, f"text {i}", []) for i, v in vec.items()] + [("b", 2020, 9, [1.0, 1.0], "alone", [])], "bank string, year int, sent_pos long, embedding array<double>, sentence string, evidence_types array<string>")
    got = {(r["bank"], r["sent_pos"]): r for r in linking.link(df, linking.VARIANTS[1]).collect()}
    assert got["a", 0]["best_evidence_pos"] == 1 and got["a", 0]["search_method"] == "window" and got["a", 0]["nli_entailment_score"] == 0.5
    assert got["a", 3]["num_evidence"] == 0 and got["a", 3]["similarity_score"] == 0 and got["a", 3]["nli_entailment_score"] == 0
    assert got["b", 9]["search_method"] == "none"


def test_theory_beside_sentences(spark):
    df = spark.createDataFrame([("Planning", 0.3, 0.2), ("Planning", 0.2, 0.4), ("Planning", 1.0, 0.1), ("Indeterminate", None, None), (None, 0.5, 0.5)], "action_label string, es_combined double, wrs double")
    got = {(r["action_label"], r["es"]): r for r in analyses.theory_and_sentences(df).collect()}
    assert len(got) == 15 and sum(r["n"] for r in got.values()) == 3
    near = got["Planning", 0.25]
    assert near["n"] == 2 and abs(near["avg_wrs"] - 0.3) < 1e-12 and abs(near["wrs"] - 0.3 * (1 - 0.65 * 0.25)) < 1e-12
    assert got["Planning", 1.0]["n"] == 1 and got["Indeterminate", 0.0]["avg_wrs"] is None
