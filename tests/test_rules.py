from pyspark.sql import functions as F

from veridicta.functions.expressions import has
from veridicta.functions.packs import ACTION_RULES, EVIDENCE, TOPIC_RULES, Rule
from veridicta.operators import evidence, neuro, rules

SENTENCES = [
    ("Ngân hàng đã giảm phát thải CO2 được 15% so với năm 2022.", "E", 0.4, ["GRI305_Emissions"], "Implemented", 1.0, ["Bloom_HighLevel_Verbs", "Quantitative_Results"], ["KPI", "Time_bound"]),
    ("Chúng tôi cam kết hướng tới phát triển bền vững.", "Non_ESG", 0.5, [], "Planning", 0.5, ["Future_Commitment"], []),
    ("Mục tiêu đạt net zero vào năm 2050 theo lộ trình đã đề ra.", "E", 0.4, ["GRI305_Emissions"], "Planning", 0.7, ["Future_Commitment"], ["Standard", "Time_bound"]),
    ("Ngân hàng luôn quan tâm, chú trọng đến môi trường làm việc cho CBNV.", "S_labor", 0.4, ["GRI402_LaborRelations"], "Indeterminate", 0.5, ["Vague_Commitment_Language"], []),
    ("Đã triển khai chương trình đào tạo cho 5.000 nhân viên trong năm 2023.", "S_labor", 0.4, ["GRI404_Training"], "Implemented", 1.0, ["Bloom_HighLevel_Verbs", "Quantitative_Results"], ["KPI", "Time_bound"]),
    ("NHÂN VIÊN được ĐÀO TẠO.\nISO 14001 do Deloitte kiểm toán, Q4/2023, Scope 1: 25 tấn CO2", "E", 0.4, ["GRI305_Emissions"], "Indeterminate", 0.3, [], ["Third_party", "KPI", "Standard", "Time_bound"]),
    ("We target 2030 and reduce energy by 12,5 % compared to 2020", "E", 0.4, ["GRI302_Energy"], "Indeterminate", 0.3, [], ["KPI", "Time_bound"]),
]


def test_pack_sizes():
    assert (len(TOPIC_RULES), sum(len(r.patterns) for r in TOPIC_RULES)) == (21, 73)
    assert (len(ACTION_RULES), sum(len(r.patterns) for r in ACTION_RULES)) == (6, 29)
    assert sum(len(e.patterns) for e in EVIDENCE) == 37
    assert len(neuro.knowledge_base("topic").constraints) == 22
    assert len(neuro.knowledge_base("action").constraints) == 9


def test_sentences(spark):
    df = spark.createDataFrame([(i, s[0], "") for i, s in enumerate(SENTENCES)] + [(99, None, None)], "i int, sentence string, section_title string")
    df = evidence.detect(rules.match_actions(rules.match_topics(df)).withColumn("text", F.col("sentence")))
    got = {r["i"]: r for r in df.collect()}
    for i, (_, topic, conf, tr, action, aconf, ar, types) in enumerate(SENTENCES):
        r = got[i]
        assert (r["topic_label"], round(r["topic_confidence"], 9), r["topic_rules"]) == (topic, conf, tr), i
        assert (r["action_label"], round(r["action_confidence"], 9), r["action_rules"]) == (action, aconf, ar), i
        assert r["evidence_types"] == types, i
    assert (got[99]["topic_label"], got[99]["action_label"], got[99]["has_evidence"]) == ("Non_ESG", "Indeterminate", False)


def test_threshold_is_a_double(spark):
    """0.5 + 0.2 - 0.3 stays under 0.4."""
    pack = (Rule("Indeterminate", "a", "", "", ("aaa",)), Rule("Indeterminate", "b", "", "", ("bbb",)), Rule("Planning", "c", "", "", ("zzz",)), Rule("Implemented", "d", "", "", ("zzz",)))
    df = spark.createDataFrame([("aaa 5%", "bbb")], "sentence string, ctx string")
    r = rules.match_actions(df, context="ctx", rules=pack).first()
    assert (r["action_label"], r["action_confidence"], r["action_rules"]) == ("Indeterminate", 0.3, [])


def test_context_hit_stops_the_rule(spark):
    pack = (Rule("E", "r", "", "", ("first", "second")), Rule("G", "q", "", "", ("third",)))
    df = spark.createDataFrame([("second third", "first")], "sentence string, section_title string")
    r = rules.match_topics(df, rules=pack).first()
    assert (r["topic_label"], r["topic_rules"]) == ("G", ["q"])


def test_unicode_case_and_boundaries(spark):
    df = spark.createDataFrame([("ĐÀO TẠO",), ("xđàoy",), (None,)], "t string")
    assert [r[0] for r in df.select(has("t", r"\bđào\b")).collect()] == [True, False, False]


def test_kpi_values_and_matches(spark):
    df = spark.createDataFrame([("Giảm 12,5 % và 3 tỷ đồng, 3 tỷ đồng, 7 kWh",)], "text string")
    r = df.select(evidence.kpi_values().alias("v"), evidence.matches_of().alias("m"), evidence.quality(evidence.types_of()).alias("q")).first()
    assert r["v"] == ["12,5 %", "3 tỷ đồng", "7 kWh"]
    assert set(r["m"]) == {"KPI"} and abs(r["q"] - 0.3) < 1e-12


def test_fusion_and_losses(spark):
    kb = neuro.knowledge_base("action")
    df = spark.createDataFrame([(SENTENCES[0][0], [0.1, 0.2, 0.3]), ("x", [1.0, 1.0, 0.0])], "sentence string, logits array<double>")
    a, b = neuro.explain(neuro.fuse(neuro.truths(df, kb), kb), kb).collect()
    assert a["label"] == "Implemented" and a["rule_adjusted"] and a["active_constraints"] == 2
    assert b["label"] == b["neural_label"] == "Implemented" and b["explanations"] == ["No symbolic constraints active for this input."]
    assert abs(sum(a["rule_probs"]) - 1) < 1e-12
    d = neuro.truths(df, kb).withColumn("probs", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    assert neuro.semantic_loss(d, kb).first()["exactly_one"] < 1e-5


def test_provenance_and_use(spark):
    told = {r["name"]: r for r in rules.provenance(spark).collect()}
    assert len(told) == 27 and all(told[r.name]["source"] == r.source and told[r.name]["num_patterns"] == len(r.patterns) for r in TOPIC_RULES + ACTION_RULES)
    df = spark.createDataFrame([(s[0], "") for s in SENTENCES] + [("x", "phát thải"), ("", ""), (None, None), (SENTENCES[0][0], None)], "sentence string, section_title string")
    used = {r["name"]: (r["in_text"], r["in_context"]) for r in rules.use(df).collect()}
    assert len(used) == len(TOPIC_RULES) and used["GRI305_Emissions"] == (4, 1) and used["GRI404_Training"][1] == 0
    none = rules.use(df.limit(0), ACTION_RULES, context=None).collect()
    assert len(none) == len(ACTION_RULES) and all((r["in_text"], r["in_context"]) == (0, 0) for r in none)
