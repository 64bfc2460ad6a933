"""Queries over the driver's tables, one for each operator or small group of them.

Mapping: bank is ``source``, year is 2020 + (doc_id div 20) mod 5, a sentence ends at a line feed or after . ? !.
The rule packs are the synthetic ones, which fire on this prose; figures that need a model are made of the ids.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions import packs
from veridicta.functions.expressions import cosine, dbl, has, nfc
from veridicta.operators import analyses, corpus, entailment, evidence, labels, linking, neuro, quality, report, risk, rules, vectors
from veridicta.plans import minibatch, training
from veridicta.plans.lineage import checkpointed, shared_folder
from veridicta.plans.shipping import ship
from veridicta.sources import tables
from veridicta.streaming.scorers import hashed_embeddings, label_batches, model_scorer, nli_scorer, surrogate_logits, train_surrogate

DIGITS = 6
TOPIC_KB = neuro.knowledge_base("topic", rules=packs.SYNTHETIC_TOPIC_RULES)
ACTION_KB = neuro.knowledge_base("action", rules=packs.SYNTHETIC_ACTION_RULES, negations=(packs.Rule("Implemented", "soft", "synthetic", "soft_neg", ("ing ", "an ")),))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison (no negative zero), arrays joined."""
    out = []
    for c, t in df.dtypes:
        if t == "double":
            out.append((F.round(c, DIGITS) + 0.0).alias(c))
        elif t == "array<string>":
            out.append(F.concat_ws(",", c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def documents(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return d.select("doc_id", "text", "lang", F.col("source").alias("bank"), (F.lit(2020) + F.floor(F.col("doc_id") / 20) % 5).cast("int").alias("year"))


def sentences(spark, sf) -> DataFrame:
    d = documents(spark, sf)
    cut = F.regexp_replace(F.regexp_replace("text", r"([.?!])[ \t\n\f\r]+", "$1\x01"), r"\n+", "\x01")
    parts = F.filter(F.transform(F.split(cut, "\x01"), lambda s: F.trim(s)), lambda s: s != "")
    s = d.select("*", F.posexplode(corpus.with_neighbours(parts)).alias("pos", "__s"))
    return s.select(
        "doc_id", "pos", F.col("__s.it").alias("sentence"), "bank", "year", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("sent_id"), F.col("lang").alias("section_title"),
        F.col("__s.prev").alias("ctx_prev"), F.col("__s.next").alias("ctx_next"),
        (F.col("doc_id") * (1 << 32) + F.col("pos")).alias("sent_pos"),
    )


SENT = r"""
WITH docs AS (SELECT doc_id, text, lang, source AS bank, CAST(2020 + (doc_id // 20) % 5 AS INTEGER) AS year FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
cutup AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.?!])[ \t\n\f\r]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS p FROM docs),
sent AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS sentence, bank, year, doc_id || '_' || (i - 1) AS sent_id, lang AS section_title,
  CASE WHEN i > 1 THEN p[i - 1] ELSE '' END AS ctx_prev, coalesce(p[i + 1], '') AS ctx_next, doc_id * 4294967296 + i - 1 AS sent_pos
  FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM cutup) WHERE len(p) > 0)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _hits_sql(pack, text: str, both: str | None) -> str:
    out = []
    for i, r in enumerate(pack):
        case = "CASE"
        for p in r.patterns:
            case += f" WHEN regexp_matches({text}, {_q(p)}) THEN 1"
            if both:
                case += f" WHEN regexp_matches({both}, {_q(p)}) THEN 2"
        out.append(case + f" END AS h{i}")
    return ", ".join(out)


def _score_sql(pack, label: str, a: float, b: float) -> str:
    return " + ".join([_d(0.0)] + [f"CASE h{i} WHEN 1 THEN {_d(a * r.weight)} WHEN 2 THEN {_d(b * r.weight)} ELSE {_d(0.0)} END" for i, r in enumerate(pack) if r.label == label])


def _label_sql(pack, names, scores: list[str], threshold: float, default: str, confidence: float, out: str) -> str:
    top = f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0]
    which = "CASE " + " ".join(f"WHEN {s} = {top} THEN {{}}" for s in scores) + " END"
    rule_lists = [
        "concat_ws(',', " + ", ".join(f"CASE h{i} WHEN 1 THEN {_q(r.name)} WHEN 2 THEN {_q(r.name + '(ctx)')} END" for i, r in enumerate(pack) if r.label == n) + ")" for n in names
    ]
    return (
        f"CASE WHEN {top} < {_d(threshold)} THEN {_q(default)} ELSE {which.format(*map(_q, names))} END AS {out}_label, "
        f"CASE WHEN {top} < {_d(threshold)} THEN {_d(confidence)} ELSE least({top}, {_d(1.0)}) END AS {out}_confidence, "
        f"CASE WHEN {top} < {_d(threshold)} THEN '' ELSE {which.format(*rule_lists)} END AS {out}_rules"
    )


_T, _A, _E = packs.SYNTHETIC_TOPIC_RULES, packs.SYNTHETIC_ACTION_RULES, packs.SYNTHETIC_EVIDENCE
_NUM, _FUT = "[0-9]{3,}", "20[0-9]{2}"
_t_names = list(dict.fromkeys(r.label for r in _T))
TOPIC = SENT + f""",
th AS (SELECT *, {_hits_sql(_T, "lower(sentence)", "lower(section_title || ' ' || sentence)")} FROM sent),
ts AS (SELECT *, {", ".join(f"{_score_sql(_T, n, 0.4, 0.1)} AS s{k}" for k, n in enumerate(_t_names))} FROM th),
topic AS (SELECT * EXCLUDE ({", ".join([f"h{i}" for i in range(len(_T))] + [f"s{k}" for k in range(len(_t_names))])}), {_label_sql(_T, _t_names, [f"s{k}" for k in range(len(_t_names))], 0.3, "Non_ESG", 0.5, "topic")} FROM ts)"""
_adj = {"Implemented": "", "Planning": f" + CASE WHEN fy THEN {_d(0.2)} ELSE {_d(0.0)} END", "Indeterminate": f" - CASE WHEN nn THEN {_d(0.3)} ELSE {_d(0.0)} END - CASE WHEN fy THEN {_d(0.2)} ELSE {_d(0.0)} END"}
ACTION = TOPIC + f""",
ah AS (SELECT *, {_hits_sql(_A, "lower(sentence)", None)}, regexp_matches(lower(sentence), {_q(_NUM)}) AS nn, regexp_matches(lower(sentence), {_q(_FUT)}) AS fy FROM topic),
asc_ AS (SELECT *, {", ".join(f"{_score_sql(_A, n, 0.5, 0.2)}{_adj[n]} AS s{k}" for k, n in enumerate(packs.ACTIONS))} FROM ah),
act AS (SELECT * EXCLUDE ({", ".join([f"h{i}" for i in range(len(_A))] + ["s0", "s1", "s2", "nn", "fy"])}), {_label_sql(_A, packs.ACTIONS, ["s0", "s1", "s2"], 0.4, "Indeterminate", 0.3, "action")} FROM asc_)"""
_any = lambda e: "(" + " OR ".join(f"regexp_matches(sentence, {_q('(?i)' + p)})" for p in e.patterns) + ")"
_found = ", ".join(f"CASE WHEN {_any(e)} THEN {_q(e.name)} END" for e in _E)
_total = sum(e.weight for e in _E)
EVID = ACTION + f""",
ev0 AS (SELECT *, list_filter([{_found}], lambda x: x IS NOT NULL) AS types FROM act),
ev AS (SELECT *, len(types) > 0 AS has_evidence, CASE WHEN len(types) > 0 THEN least(({" + ".join([_d(0.0)] + [f"CASE WHEN list_contains(types, {_q(e.name)}) THEN {_d(e.weight)} ELSE {_d(0.0)} END" for e in _E])}) / {_d(_total)}, 1) ELSE {_d(0.0)} END AS quality FROM ev0)"""
SCORED = EVID + """,
sc0 AS (SELECT *, CAST((doc_id * 31 + pos * 7) % 97 AS DOUBLE) / 97 AS similarity_score, CASE (doc_id + pos) % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS nli_label,
  CAST((doc_id * 13 + pos * 5) % 89 AS DOUBLE) / 89 AS ent FROM ev),
st AS (SELECT bank, year, avg(similarity_score) AS m, stddev_samp(similarity_score) AS s FROM sc0 WHERE bank IS NOT NULL GROUP BY ALL),
sc1 AS (SELECT sc0.*, coalesce(m, 0) AS sim_doc_mean, coalesce(s, CAST(0.1 AS DOUBLE)) AS sim_doc_std FROM sc0 LEFT JOIN st USING (bank, year)),
sc2 AS (SELECT *, CASE WHEN (CASE WHEN sim_doc_std = 0 THEN CAST(0.1 AS DOUBLE) ELSE sim_doc_std END) > CAST(0.01 AS DOUBLE)
  THEN least(greatest((similarity_score - sim_doc_mean) / (2 * CASE WHEN sim_doc_std = 0 THEN CAST(0.1 AS DOUBLE) ELSE sim_doc_std END), 0), 1) ELSE least(greatest(similarity_score, 0), 1) END AS cal FROM sc1),
sc3 AS (SELECT *, least(greatest(CAST(0.35 AS DOUBLE) * quality + CAST(0.35 AS DOUBLE) * cal + CAST(0.3 AS DOUBLE) * CASE WHEN nli_label = 'entailment' THEN ent ELSE 0 END, 0), 1) AS es_combined FROM sc2),
sc4 AS (SELECT *, CASE action_label WHEN 'Implemented' THEN CAST(0.08 AS DOUBLE) WHEN 'Planning' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END
  * (1 - CASE action_label WHEN 'Implemented' THEN CAST(0.8 AS DOUBLE) WHEN 'Planning' THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * es_combined) AS b FROM sc3),
scored AS (SELECT *, least(greatest(CASE WHEN nli_label = 'contradiction' THEN least(b * CAST(1.3 AS DOUBLE), 1) ELSE b END, 0), 1) AS wrs,
  (CASE action_label WHEN 'Indeterminate' THEN 2 WHEN 'Planning' THEN 1 ELSE 0 END + (1 - es_combined)) / 4 AS wrs_old FROM sc4)"""
_lvl = lambda x, a=25, b=38, c=43: f"CASE WHEN {x} < {a} THEN 'Low' WHEN {x} < {b} THEN 'Medium' WHEN {x} < {c} THEN 'High' ELSE 'Very High' END"
_cnt = lambda c: f"count(*) FILTER (WHERE {c})"
_ns = [f"n_{t}" for t in packs.ESG_TOPICS]


def _entropy_sql(cs: list[str]) -> str:
    t = "(" + " + ".join(cs) + ")"
    bits = " + ".join(f"CASE WHEN {c} > 0 THEN -(CAST({c} AS DOUBLE) / {t}) * log2(CAST({c} AS DOUBLE) / {t}) ELSE 0 END" for c in cs)
    k = "(" + " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in cs) + ")"
    return f"CASE WHEN {k} > 1 THEN ({bits}) / log2(CAST({k} AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"


BY = SCORED + f""",
by0 AS (SELECT bank, year, count(*) AS total_sentences, {", ".join(_cnt(f"action_label = '{a}'") + f" AS {a.lower()}" for a in packs.ACTIONS)}, {_cnt("has_evidence")} AS with_evidence, avg(es_combined) AS avg_evidence_strength,
  avg(wrs) * 100 AS ewri, avg(wrs_old) * 100 AS ewri_old, {", ".join(f"sum(CASE WHEN action_label = '{a}' THEN wrs ELSE 0 END) / count(*) * 100 AS contrib_{a.lower()}" for a in packs.ACTIONS)},
  {", ".join(_cnt(f"topic_label = '{t}'") + f" AS n_{t}" for t in packs.ESG_TOPICS)} FROM scored WHERE bank IS NOT NULL GROUP BY bank, year),
bys AS (SELECT *, total_sentences - with_evidence AS without_evidence, {", ".join(f"{a.lower()} / total_sentences AS {a.lower()}_ratio" for a in packs.ACTIONS)}, with_evidence / total_sentences AS evidence_ratio,
  {_lvl("ewri")} AS risk_level, {_entropy_sql(_ns)} AS topic_entropy FROM by0)"""


def topics(spark, sf):
    return rules.match_topics(sentences(spark, sf), rules=_T)


def actions(spark, sf):
    return rules.match_actions(topics(spark, sf), rules=_A, numbers=_NUM, future=_FUT)


def with_evidence(spark, sf):
    return evidence.detect(actions(spark, sf).withColumn("text", F.col("sentence")), pack=_E, kpis=packs.SYNTHETIC_KPI_VALUES)


def scored(spark, sf):
    i, p = F.col("doc_id"), F.col("pos")
    k = (i + p) % 3
    d = with_evidence(spark, sf).withColumns({
        "similarity_score": ((i * 31 + p * 7) % 97).cast("double") / 97, "nli_label": F.when(k == 0, "entailment").when(k == 1, "neutral").otherwise("contradiction"),
        "nli_entailment_score": ((i * 13 + p * 5) % 89).cast("double") / 89, "best_evidence": F.lit(None).cast("string"),
    })
    return risk.enrich(d, _E)


def scores(spark, sf):
    return risk.bank_years(scored(spark, sf))


def logits(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("logits", F.array(*(((F.col("doc_id") * (k + 3) + F.col("pos") * 11) % 17).cast("double") / 5 for k in range(n))))


def fused(spark, sf):
    return neuro.fuse(neuro.truths(logits(sentences(spark, sf), 6), TOPIC_KB), TOPIC_KB)


def linkable(spark, sf):
    """All documents as claims of their source, in the order of their ids: the table's vector of that number, or one made
    of the id where there is none."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("bank"), F.lit(2020).alias("year"), F.coalesce("text", F.lit("")).alias("sentence"))
    made = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: ((F.col("doc_id") * k) % 17 - 8).cast("double"))
    d = d.join(e, "doc_id", "left").withColumn("embedding", F.coalesce(F.col("embedding").cast("array<double>"), made))
    d = corpus.with_position(d, "doc_id", "sentence", by=("bank", "year")).withColumn("text", F.col("sentence"))
    d = evidence.detect(d, pack=_E, kpis=packs.SYNTHETIC_KPI_VALUES)
    return d.withColumn("action_label", F.when(F.col("sent_pos") % 3 == 0, "Indeterminate").otherwise("Implemented"))


LINK = f"""
WITH l0 AS (SELECT source AS bank, 2020 AS year, doc_id, coalesce(CAST(embedding AS DOUBLE[]), list_transform(generate_series(1, 64), lambda k: CAST((doc_id * k) % 17 - 8 AS DOUBLE))) AS v, coalesce(text, '') AS sentence
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
l AS (SELECT *, row_number() OVER (PARTITION BY bank, year ORDER BY doc_id, sentence) - 1 AS sent_pos, list_filter([{_found}], lambda x: x IS NOT NULL) AS types FROM l0),
win AS (SELECT a.bank, a.year, a.sent_pos AS claim, b.sent_pos AS evidence, 1 - abs(a.sent_pos - b.sent_pos) / CAST(6 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS boost
  FROM l a JOIN l b ON a.bank = b.bank AND a.year = b.year AND a.sent_pos <> b.sent_pos AND abs(a.sent_pos - b.sent_pos) <= 5)"""
WINLINK = LINK + """,
sim AS (SELECT w.*, list_cosine_similarity(a.v, b.v) AS raw, b.sentence AS best FROM win w JOIN l a ON a.bank = w.bank AND a.sent_pos = w.claim JOIN l b ON b.bank = w.bank AND b.sent_pos = w.evidence),
rk AS (SELECT *, row_number() OVER (PARTITION BY bank, claim ORDER BY round(raw * boost, 9) DESC, evidence) AS r FROM sim),
fit AS (SELECT *, row_number() OVER (PARTITION BY bank, claim ORDER BY r) AS k FROM rk WHERE r <= 6 AND raw >= CAST(0.4 AS DOUBLE)),
lk AS (SELECT bank, claim, min_by(evidence, k) AS best_evidence_pos, min_by(raw, k) AS s, count(*) AS n, avg(raw) AS a FROM fit WHERE k <= 3 GROUP BY ALL),
seen AS (SELECT bank, claim, max(raw) AS m FROM sim GROUP BY ALL),
linked AS (SELECT l.bank, l.year, l.sent_pos, best_evidence_pos, coalesce(s, m, 0) AS similarity_score, coalesce(n, 0) AS num_evidence, coalesce(a, 0) AS avg_similarity,
  CASE WHEN m IS NULL THEN 'none' ELSE 'window' END AS search_method, CASE WHEN n IS NULL THEN 0 ELSE CAST(0.5 AS DOUBLE) END AS nli_entailment_score, 'neutral' AS nli_label, len(types) > 0 AS has_evidence
  FROM l LEFT JOIN seen ON seen.bank = l.bank AND seen.claim = l.sent_pos LEFT JOIN lk ON lk.bank = l.bank AND lk.claim = l.sent_pos)"""
TFIDF = LINK + r""",
w AS (SELECT bank, year, sent_pos AS pos, regexp_extract_all(lower(sentence), '[\p{L}\p{N}_\p{M}]+') AS raw FROM l),
w1 AS (SELECT bank, year, pos, list_filter(raw, lambda x: len(x) > 1) AS ws FROM w),
w2 AS (SELECT bank, year, pos, list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS ts FROM w1),
tf AS (SELECT bank, year, pos, term, count(*) AS tf FROM (SELECT bank, year, pos, unnest(ts) AS term FROM w2) GROUP BY ALL),
n AS (SELECT bank, year, count(*) AS n FROM l GROUP BY ALL),
voc AS (SELECT tf.bank, tf.year, term, count(*) AS df, sum(tf) AS cf, any_value(n) AS n FROM tf JOIN n USING (bank, year) GROUP BY tf.bank, tf.year, term HAVING count(*) <= CAST(0.95 AS DOUBLE) * any_value(n)),
vr AS (SELECT *, row_number() OVER (PARTITION BY bank, year ORDER BY cf DESC, term) AS r FROM voc),
wt AS (SELECT tf.bank, tf.year, pos, tf.term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN vr ON vr.bank = tf.bank AND vr.year = tf.year AND vr.term = tf.term AND r <= 3000),
tfidf AS (SELECT bank, year, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY bank, year, pos)) AS weight FROM wt)"""

_SIM = """al AS (SELECT x.bank, x.sent_pos AS claim, y.sent_pos AS evidence, coalesce(sim, 0) AS sim FROM l x JOIN l y ON x.bank = y.bank JOIN n ON n.bank = x.bank AND n.n > 10
  LEFT JOIN (SELECT a.bank, a.pos AS claim, b.pos AS evidence, sum(a.weight * b.weight) AS sim FROM tfidf a JOIN tfidf b ON a.bank = b.bank AND a.term = b.term GROUP BY ALL) dot ON dot.bank = x.bank AND dot.claim = x.sent_pos AND dot.evidence = y.sent_pos),
dc AS (SELECT bank, claim, evidence, CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * sim AS boost FROM (SELECT *, row_number() OVER (PARTITION BY bank, claim ORDER BY round(sim, 9) DESC, evidence) AS r FROM al) WHERE r <= 21 AND abs(claim - evidence) > 5)"""


def _linked_sql(name: str, nli: bool) -> str:
    """The variants that search the whole document, with or without the word-overlap scorer."""
    words = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda x: len(x) > 1))".replace("\\\\", "\\")
    label = "CASE WHEN ov >= CAST(0.5 AS DOUBLE) THEN 'entailment' WHEN ov < CAST(0.02 AS DOUBLE) THEN 'contradiction' ELSE 'neutral' END"
    return f"""{name}_c AS (SELECT bank, claim, evidence, boost, 'window' AS way FROM win UNION ALL SELECT bank, claim, evidence, boost, 'document' FROM dc),
{name}_s AS (SELECT w.*, list_cosine_similarity(a.v, b.v) AS raw, len(list_intersect({words.format("a.sentence")}, {words.format("b.sentence")})) / greatest(len({words.format("a.sentence")}), 1) AS ov
  FROM {name}_c w JOIN l a ON a.bank = w.bank AND a.sent_pos = w.claim JOIN l b ON b.bank = w.bank AND b.sent_pos = w.evidence),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY bank, claim ORDER BY round(raw * boost, 9) DESC, evidence) AS r, {label if nli else "'neutral'"} AS label, {"ov" if nli else "CAST(0.5 AS DOUBLE)"} AS ent FROM {name}_s),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY bank, claim ORDER BY r) AS k FROM {name}_r WHERE r <= 6 AND raw >= CAST(0.4 AS DOUBLE) AND NOT (label = 'contradiction' AND ent < CAST(0.2 AS DOUBLE))),
{name}_k AS (SELECT bank, claim, min_by(evidence, k) AS best, min_by(raw, k) AS s, count(*) AS c, avg(raw) AS a, min_by(ent, k) AS e, min_by(label, k) AS lb, min(way) AS way FROM {name}_f WHERE k <= 3 GROUP BY ALL),
{name} AS (SELECT l.bank, l.year, l.sent_pos, best AS best_evidence_pos, coalesce(s, m, 0) AS similarity_score, coalesce(c, 0) AS num_evidence, coalesce(a, 0) AS avg_similarity,
  CASE WHEN m IS NULL THEN 'none' WHEN c IS NULL OR way <> 'document' THEN CASE WHEN c IS NULL THEN 'document' ELSE 'window' END ELSE 'document_window' END AS search_method, coalesce(e, 0) AS nli_entailment_score, coalesce(lb, 'neutral') AS nli_label, len(types) > 0 AS has_evidence
  FROM l LEFT JOIN (SELECT bank, claim, max(raw) AS m FROM {name}_s GROUP BY ALL) seen ON seen.bank = l.bank AND seen.claim = l.sent_pos LEFT JOIN {name}_k y ON y.bank = l.bank AND y.claim = l.sent_pos)"""


def _summary_sql(variant: str, rows: str) -> str:
    shares = ", ".join(f"round(avg(CASE WHEN nli_label = '{x}' THEN 1.0 ELSE 0.0 END), 6) AS {x}_share" for x in ("entailment", "contradiction", "neutral"))
    return f"""SELECT '{variant}' AS evidence_variant, count(*) AS rows, round(avg(CASE WHEN has_evidence THEN 1.0 ELSE 0.0 END), 6) AS evidence_rate, round(avg(similarity_score), 6) AS avg_similarity, round(avg(nli_entailment_score), 6) AS avg_nli_entailment,
  {shares}, round(avg(CASE WHEN sent_pos % 3 = 0 AND NOT has_evidence THEN 1.0 ELSE 0.0 END), 6) AS high_risk_rate FROM {rows}"""


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf: r6(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in cols)


def _dec(c: str, digits: int) -> str:
    """Rounding of the decimal that a double prints as, which is what Spark rounds."""
    return f"CAST(round(CAST({c} AS DECIMAL(18, 12)), {digits}) AS DOUBLE)"


@query("a4_scan", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def a4(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace(replace({}, chr(160), ' '), '…', '.'), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"
_CONTENT = "replace(text, chr(10), chr(10) || ' ' || chr(10))"


@query("b1_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents")
def b1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(nfc("text").cast("binary")).alias("h"))


@query("b2_normalize", f"SELECT doc_id, md5({_NORM.format('text')}) AS h, length({_NORM.format('text')}) AS n FROM documents")
def b2(spark, sf):
    t = corpus.normalize(F.col("text"), compose=False)
    return table(spark, sf, "documents").select("doc_id", F.md5(t.cast("binary")).alias("h"), F.length(t).alias("n"))


_LINES = r"list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_UP = "(upper({0}) = {0} AND lower({0}) <> {0})"
_HEAD = r"regexp_replace(regexp_replace(regexp_replace(b, '(?m)^#{1,6}\s+', '', 'g'), '\s*\n\s*', ' ', 'g'), ':+$', '')"
BLOCKS = rf"""
WITH docs AS (SELECT doc_id, source AS bank, text, string_split(replace({_CONTENT}, chr(10) || ' ' || chr(10), chr(1)), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
p2 AS (SELECT doc_id, bank, list_filter(list_transform(p, lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM docs),
bl AS (SELECT doc_id, bank, CAST(i - 1 AS INTEGER) AS order_in_doc, p[i] AS b FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM p2) WHERE len(p) > 0),
b1 AS (SELECT *, {_LINES} AS ls, (regexp_matches(b, '^#{{1,6}}\s+') OR (length(b) < 90 AND {_UP.format("b")})) AS hd, {_HEAD} AS h FROM bl),
blocks AS (SELECT doc_id, bank, order_in_doc, b, h, CASE WHEN hd AND regexp_matches(h, '^[A-Z]\d{{2}}[/\-][A-Z0-9\-]+$') THEN 'meta_heading' WHEN hd THEN 'heading_like'
  WHEN len(ls) >= 3 AND (len(list_filter(ls, lambda x: contains(x, '|'))) / len(ls) >= 0.5 OR len(list_filter(ls, lambda x: regexp_matches(x, '\S+\s{{2,}}\S+'))) / len(ls) >= 0.6) THEN 'table_like'
  WHEN len(ls) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(x, '^(-|•|♦|\+)\s+'))) / len(ls) >= 0.5 THEN 'bullet_like'
  WHEN regexp_matches(b, '(?i)%|tỷ|triệu|nghìn|tấn|kg|CO2|Scope|KPI') AND regexp_matches(b, '\p{{Nd}}') THEN 'kpi_like' ELSE 'paragraph' END AS block_type FROM b1)"""


def _blocks(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    raw = d.select("doc_id", F.col("source").alias("bank"), F.lit(2020).alias("year"), F.lit("x").alias("path"), F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("content"))
    return corpus.build_blocks(raw, compose=False)


@query("b9_block_types", BLOCKS + " SELECT bank, block_type, count(*) AS n, sum(length(b)) AS chars FROM blocks GROUP BY ALL")
def b9(spark, sf):
    return _blocks(spark, sf).groupBy("bank", "block_type").agg(F.count("*").alias("n"), F.sum(F.length("block_text")).alias("chars"))


@query(
    "b13_sections",
    BLOCKS + """, s AS (SELECT doc_id, order_in_doc, sum(CASE WHEN block_type = 'heading_like' THEN 1 ELSE 0 END) OVER w AS k,
  last_value(CASE WHEN block_type = 'heading_like' THEN regexp_replace(h, '^\\s+|\\s+$', '', 'g') END IGNORE NULLS) OVER w AS t FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY order_in_doc ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, doc_id || '_sec' || CAST(k AS BIGINT) AS section_id, coalesce(t, 'UNKNOWN') AS section_title, count(*) AS n FROM s GROUP BY ALL""",
)
def b13(spark, sf):
    return _blocks(spark, sf).groupBy("doc_id", "section_id", "section_title").agg(F.count("*").alias("n"))


_NOISE_SQL = " OR ".join(f"regexp_matches(s, {_q('(?i)' + p)})" for p in corpus.NOISE)
NOISY = rf"""(length(s) < 15 OR ({_UP.format("s")} AND length(s) < 80) OR {_NOISE_SQL} OR length(regexp_replace(s, '\P{{L}}', '', 'g')) / greatest(length(s), 1) < CAST(0.3 AS DOUBLE))"""


@query("b10_sentences", SENT + " SELECT bank, year, count(*) AS n, sum(length(sentence)) AS chars FROM sent GROUP BY ALL")
def b10(spark, sf):
    return sentences(spark, sf).groupBy("bank", "year").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(
    "b10_split",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_strip("text")}, '([.?!]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(p) AS n, md5(array_to_string(p, chr(2))) AS h FROM p""".replace("\\\\1", "\\1"),
)
def b10s(spark, sf):
    """The corpus' own splitter on whole texts."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("p", corpus.sentences_of(F.col("text")))
    return d.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\x02").cast("binary")).alias("h"))


@query("b12_noise", SENT + f", x AS (SELECT bank, sentence AS s FROM sent) SELECT bank, count(*) AS n, count(*) FILTER (WHERE {NOISY}) AS noise FROM x GROUP BY bank")
def b12(spark, sf):
    return sentences(spark, sf).groupBy("bank").agg(F.count("*").alias("n"), F.count_if(corpus.is_noise(F.col("sentence"))).alias("noise"))


_PIECES = r"list_filter(list_transform(string_split(regexp_replace(b, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_LONG = NOISY.replace("s,", "x,").replace("(s)", "(x)").replace("length(s", "length(x").replace("upper(s", "upper(x").replace(" = s ", " = x ").replace("<> s)", "<> x)")


@query(
    "b14_context",
    BLOCKS + f""", k AS (SELECT doc_id, order_in_doc, list_filter({_PIECES}, lambda x: length(x) >= 10 AND NOT {_LONG}) AS p FROM blocks WHERE block_type NOT IN ('heading_like', 'meta_heading')),
  e AS (SELECT doc_id, order_in_doc, p, unnest(generate_series(1, len(p))) AS i FROM k WHERE len(p) > 0)
  SELECT doc_id || '_s' || order_in_doc || '_' || (i - 1) AS sent_id, md5(p[i]) AS h, CASE WHEN i > 1 THEN length(p[i - 1]) ELSE 0 END AS prev_n, coalesce(length(p[i + 1]), 0) AS next_n FROM e""",
)
def b14(spark, sf):
    s = corpus.build_sentences(_blocks(spark, sf))
    return s.select("sent_id", F.md5(F.col("sentence").cast("binary")).alias("h"), F.length("ctx_prev").alias("prev_n"), F.length("ctx_next").alias("next_n"))


_PLACES = BLOCKS + f""", k AS (SELECT doc_id, bank, order_in_doc, list_filter({_PIECES}, lambda x: length(x) >= 10 AND NOT {_LONG}) AS p FROM blocks WHERE block_type NOT IN ('heading_like', 'meta_heading')),
  e AS (SELECT doc_id, bank, order_in_doc, p, unnest(generate_series(1, len(p))) AS i FROM k WHERE len(p) > 0),
  pl AS (SELECT bank, doc_id || '_s' || order_in_doc || '_' || (i - 1) AS sent_id, row_number() OVER (PARTITION BY bank ORDER BY doc_id, order_in_doc, i) - 1 AS sent_pos FROM e)"""


def placed(spark, sf):
    return corpus.text_position(corpus.build_sentences(_blocks(spark, sf)))


@query("m1_text_positions", _PLACES + " SELECT sent_id, sent_pos FROM pl")
def m1(spark, sf):
    return placed(spark, sf).select("sent_id", "sent_pos")


@query("m1_text_window", _PLACES + " SELECT a.sent_id, count(*) AS n, sum(b.sent_pos - a.sent_pos) AS balance FROM pl a JOIN pl b ON a.bank = b.bank AND a.sent_pos <> b.sent_pos AND abs(a.sent_pos - b.sent_pos) <= 5 GROUP BY a.sent_id")
def m1w(spark, sf):
    d = checkpointed(placed(spark, sf).select("bank", "year", "sent_id", "sent_pos"))  # texts are cut once, not by each side
    near = linking.window_candidates(d).groupBy("bank", "year", F.col("claim").alias("sent_pos")).agg(F.count("*").alias("n"), F.sum(F.col("evidence") - F.col("claim")).alias("balance"))
    return d.join(near, ["bank", "year", "sent_pos"]).select("sent_id", "n", "balance")


@query("b16_is_heading", SENT + f" SELECT section_title, count(*) FILTER (WHERE length(sentence) <= 120 AND ({_UP.format('sentence')} OR (sentence LIKE '%:' AND length(sentence) < 100))) AS headings FROM sent GROUP BY ALL")
def b16(spark, sf):
    return sentences(spark, sf).groupBy("section_title").agg(F.count_if(corpus.is_heading(F.col("sentence"))).alias("headings"))


@query("b17_model_text", SENT + " SELECT sent_id, md5(concat_ws(' ', nullif(ctx_prev, ''), sentence, nullif(ctx_next, ''))) AS h FROM sent")
def b17(spark, sf):
    return sentences(spark, sf).select("sent_id", F.md5(corpus.model_text().cast("binary")).alias("h"))


@query(
    "b18_prompt",
    SENT + """ SELECT sent_id, md5(CASE WHEN ctx_prev <> '' THEN '[Cau truoc]: ' || ctx_prev || chr(10) ELSE '' END || '[Cau can phan loai]: ' || sentence || chr(10)
  || CASE WHEN ctx_next <> '' THEN '[Cau sau]: ' || ctx_next || chr(10) ELSE '' END || '[Section]: ' || coalesce(section_title, '')) AS h FROM sent""",
)
def b18(spark, sf):
    return sentences(spark, sf).select("sent_id", F.md5(corpus.prompt("Section", F.col("section_title")).cast("binary")).alias("h"))


@query("t7_positions", SENT + " SELECT sent_id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM sent")
def t7(spark, sf):
    return corpus.with_position(sentences(spark, sf), "doc_id", "pos", name="place").select("sent_id", "place")


@query("c1_length", SENT + " SELECT bank, sum(length(sentence)) AS chars, count(*) FILTER (WHERE length(sentence) BETWEEN 20 AND 500) AS ok FROM sent GROUP BY bank")
def c1(spark, sf):
    return quality.check_length(sentences(spark, sf)).groupBy("bank").agg(F.sum("_char_len").alias("chars"), F.count_if("_length_ok").alias("ok"))


_GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 2), lambda i: substr({0}, i, 3)))"


@query(
    "c3_jaccard",
    SENT + f""", g AS (SELECT sent_id, {_GRAMS.format("lower(sentence)")} AS a, {_GRAMS.format("lower(ctx_next)")} AS b, length(sentence) AS la, length(ctx_next) AS lb FROM sent WHERE doc_id % 5 = 0 OR TRUE),
  h AS (SELECT sent_id, la, lb, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS c FROM g)
  SELECT sent_id, round(CASE WHEN la < 3 OR lb < 3 THEN 0 ELSE c / (na + nb - c) END, 6) + 0 AS similarity FROM h""".replace(" WHERE doc_id % 5 = 0 OR TRUE", ""),
)
def c3(spark, sf):
    return sentences(spark, sf).select("sent_id", quality.text_jaccard(F.col("sentence"), F.col("ctx_next")).alias("similarity"))


@query("c4_near_duplicates")
def c4(spark, sf):
    d = quality.pairwise_duplicates(sentences(spark, sf), "sent_pos")
    return d.groupBy("bank").agg(F.count("*").alias("n"), F.count_if("_is_duplicate").alias("duplicates"))


@query("c4_greedy")
def c4_greedy(spark, sf):
    """The sequential rule over all sentences in the order of their documents."""
    d = quality.greedy_duplicates(sentences(spark, sf).select("bank", "sent_pos", "sentence"), "sent_pos")
    return d.groupBy("bank").agg(F.count("*").alias("n"), F.count_if("_is_duplicate").alias("duplicates"))


@query("c4_greedy_by_document")
def c4g(spark, sf):
    d = quality.greedy_duplicates(sentences(spark, sf).select("doc_id", "pos", "sentence"), "pos", group="doc_id")
    return d.groupBy("doc_id").agg(F.count_if("_is_duplicate").alias("duplicates"))


# RE2 has no back-references and no boundaries of Unicode words: runs of each character, and words by themselves
_RUNS = "|".join([f"\\\\x{{{k:x}}}{{{{5,}}}}".replace("\\\\", "\\").replace("{{", "{").replace("}}", "}") for k in [9, 11, 12, 13, *range(32, 127), *range(160, 384)]])
_OCR = f"""len(list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '[bcdfghjklmnpqrstvwxyz]{{4,}}'))) + len(regexp_extract_all(sentence, '[\\x{{fffd}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))
  + len(regexp_extract_all(sentence, {_q(r"""[^\p{L}\p{N}\p{M}_\s.,;:!?\-()"'%/]{3,}""")})) + len(regexp_extract_all(sentence, {_q(_RUNS)})) + len(regexp_extract_all(sentence, {_q("(?i)[a-zA-Z][àáảãạăắằẳẵặâấầẩẫậ][a-zA-Z]{2}[àáảãạ]")}))"""


@query("c6_ocr", SENT + f", x AS (SELECT bank, CAST({_OCR} AS DOUBLE) / greatest(length(sentence), 1) AS r FROM sent) SELECT bank, count(*) FILTER (WHERE r <= CAST(0.1 AS DOUBLE)) AS clean, round(avg(r), 6) AS ratio FROM x GROUP BY bank")
def c6(spark, sf):
    return quality.check_ocr(sentences(spark, sf)).groupBy("bank").agg(F.count_if("_ocr_clean").alias("clean"), F.avg("_ocr_artifact_ratio").alias("ratio"))


@query(
    "c7_class_balance",
    TOPIC + """, g AS (SELECT topic_label AS label, count(*) AS n FROM topic GROUP BY ALL), h AS (SELECT *, n / sum(n) OVER () * 100 AS pct FROM g)
  SELECT label, n, round(pct, 6) AS pct, pct < 5 AS imbalanced, NOT bool_or(pct < 5) OVER () AS is_balanced FROM h""",
)
def c7(spark, sf):
    return quality.class_balance(topics(spark, sf), "topic_label")


@query("c5_sample", SENT + " SELECT sent_pos FROM sent ORDER BY md5('42:' || sent_pos), sent_pos LIMIT 10000")
def c5(spark, sf):
    return quality.sample_for_duplicates(sentences(spark, sf), "sent_pos").select("sent_pos")


@query("c8_report")
def c8(spark, sf):
    return quality.report(quality.run_checks(sentences(spark, sf), "sent_pos"))


@query("d4_topics", TOPIC + " SELECT sent_id, topic_label, round(topic_confidence, 6) AS topic_confidence, topic_rules FROM topic")
def d4(spark, sf):
    return topics(spark, sf).select("sent_id", "topic_label", "topic_confidence", "topic_rules")


@query("d5_actions", ACTION + " SELECT sent_id, action_label, round(action_confidence, 6) AS action_confidence, action_rules FROM act")
def d5(spark, sf):
    return actions(spark, sf).select("sent_id", "action_label", "action_confidence", "action_rules")


def _use_sql(pack, hits: str, context: bool) -> str:
    told = "CAST(coalesce(sum(CASE h{i} WHEN {k} THEN 1 END), 0) AS BIGINT)"
    return " UNION ALL ".join(
        f"SELECT {_q(r.label)} AS label, {_q(r.name)} AS name, {_q(r.source)} AS source, {_q(r.description)} AS description, {len(r.patterns)} AS num_patterns, {told.format(i=i, k=1)} AS in_text, {told.format(i=i, k=2) if context else 'CAST(0 AS BIGINT)'} AS in_context FROM {hits}"
        for i, r in enumerate(pack)
    )


@query("d7_provenance", ACTION + " " + _use_sql(_T, "th", True) + " UNION ALL " + _use_sql(_A, "ah", False))
def d7(spark, sf):
    """Where each rule comes from, and how many sentences it hits."""
    s = sentences(spark, sf)
    return rules.use(s, _T).unionByName(rules.use(s, _A, context=None))


# Sentences of the real packs' own words, with what they must come out as: topic, its confidence and rules, action, its
# confidence and rules, evidence types.
REAL = (
    ("Ngân hàng đã giảm phát thải CO2 được 15% so với năm 2022.", "E", 0.4, "GRI305_Emissions", "Implemented", 1.0, "Bloom_HighLevel_Verbs,Quantitative_Results", "KPI,Time_bound"),
    ("Chúng tôi cam kết hướng tới phát triển bền vững.", "Non_ESG", 0.5, "", "Planning", 0.5, "Future_Commitment", ""),
    ("Mục tiêu đạt net zero vào năm 2050 theo lộ trình đã đề ra.", "E", 0.4, "GRI305_Emissions", "Planning", 0.7, "Future_Commitment", "Standard,Time_bound"),
    ("Ngân hàng luôn quan tâm, chú trọng đến môi trường làm việc cho CBNV.", "S_labor", 0.4, "GRI402_LaborRelations", "Indeterminate", 0.5, "Vague_Commitment_Language", ""),
    ("Đã triển khai chương trình đào tạo cho 5.000 nhân viên trong năm 2023.", "S_labor", 0.4, "GRI404_Training", "Implemented", 1.0, "Bloom_HighLevel_Verbs,Quantitative_Results", "KPI,Time_bound"),
    ("NHÂN VIÊN được ĐÀO TẠO.\nISO 14001 do Deloitte kiểm toán, Q4/2023, Scope 1: 25 tấn CO2", "E", 0.4, "GRI305_Emissions", "Indeterminate", 0.3, "", "Third_party,KPI,Standard,Time_bound"),
    ("We target 2030 and reduce energy by 12,5 % compared to 2020", "E", 0.4, "GRI302_Energy", "Indeterminate", 0.3, "", "KPI,Time_bound"),
)


@query(
    "d1_real_packs",
    "WITH real AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(r[1])}, {_d(r[2])}, {_q(r[3])}, {_q(r[4])}, {_d(r[5])}, {_q(r[6])}, {_q(r[7])})" for i, r in enumerate(REAL))
    + f") x(i, topic_label, topic_confidence, topic_rules, action_label, action_confidence, action_rules, evidence_types)) SELECT doc_id, real.* EXCLUDE (i) FROM documents JOIN real ON i = doc_id % {len(REAL)}",
)
def d1_real(spark, sf):
    """The real packs, over a sentence of their own words for every document."""
    texts = F.array(*(F.lit(r[0]) for r in REAL))
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", F.element_at(texts, (F.col("doc_id") % len(REAL) + 1).cast("int")).alias("sentence"), F.lit("").alias("section_title"))
    d = evidence.detect(rules.match_actions(rules.match_topics(d)).withColumn("text", F.col("sentence")))
    return d.select("doc_id", "topic_label", "topic_confidence", "topic_rules", "action_label", "action_confidence", "action_rules", "evidence_types")


@query("d_full_packs")
def d_full(spark, sf):
    d = rules.match_actions(rules.match_topics(sentences(spark, sf)))
    d = evidence.detect(d.withColumn("text", F.col("sentence")))
    return d.groupBy("topic_label", "action_label").agg(F.count("*").alias("n"), F.count_if("has_evidence").alias("with_evidence"))


@query("e1_wants_label", SENT + r" SELECT bank, count(*) AS n FROM sent WHERE NOT regexp_matches(sentence, '<!-- image -->|^\d+$') AND length(sentence) >= 20 GROUP BY bank")
def e1(spark, sf):
    return labels.wants_label(sentences(spark, sf)).groupBy("bank").agg(F.count("*").alias("n"))


@query("e2_resume", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY lang")
def e2(spark, sf):
    return labels.not_yet(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "e5_parse_reply",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'Non_ESG' ELSE role END AS label, CASE WHEN turn % 4 = 3 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS confidence,
  CASE WHEN turn % 4 = 3 THEN 'parse_error' ELSE 'r' END AS reason FROM conversations""",
)
def e5(spark, sf):
    good = F.concat(F.lit('Here: {"topic": "'), "role", F.lit('", "confidence": 0.75, "reason": "r"} ok'))
    c = table(spark, sf, "conversations").withColumn("reply", F.when(F.col("turn") % 4 == 3, "no answer").otherwise(good))
    a, b, r = labels.parse_reply(F.col("reply"), "topic", "Non_ESG")
    return c.select("conv_id", "turn", a.alias("label"), b.alias("confidence"), r.alias("reason"))


_PAIR = """WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'G' WHEN 2 THEN 'Other' END AS llm_label, CAST(doc_id % 10 AS DOUBLE) / 10 AS llm_confidence,
  CASE WHEN quality = 1 THEN 'E' ELSE 'G' END AS rule_label FROM labels),
y AS (SELECT *, coalesce(llm_label IN ('E', 'G'), false) AS a, rule_label IN ('E', 'G') AS b FROM x),
rec AS (SELECT doc_id, llm_label, rule_label, CASE WHEN a THEN llm_label WHEN b THEN rule_label END AS topic_label,
  CASE WHEN a AND b AND llm_label = rule_label THEN greatest(llm_confidence, CAST(0.9 AS DOUBLE)) WHEN a AND b THEN llm_confidence * CAST(0.8 AS DOUBLE) WHEN a THEN llm_confidence WHEN b THEN CAST(0.6 AS DOUBLE) ELSE 0 END AS topic_confidence,
  CASE WHEN a AND b AND llm_label = rule_label THEN 'llm+rule_agree' WHEN a AND b THEN 'llm+rule_disagree' WHEN a THEN 'llm_only' WHEN b THEN 'rule_only' ELSE 'none' END AS label_source FROM y)"""


def _pair(spark, sf):
    k = F.col("doc_id") % 4
    x = table(spark, sf, "labels").withColumns({"llm_label": F.when(k == 0, "E").when(k == 1, "G").when(k == 2, "Other"), "llm_confidence": (F.col("doc_id") % 10).cast("double") / 10, "rule_label": F.when(F.col("quality") == 1, "E").otherwise("G")})
    return labels.reconcile(x)


@query("e7_reconcile", _PAIR + " SELECT doc_id, topic_label, round(topic_confidence, 6) AS topic_confidence, label_source FROM rec")
def e7(spark, sf):
    return _pair(spark, sf).select("doc_id", "topic_label", "topic_confidence", "label_source")


@query("e6_hybrid", _PAIR + " SELECT rec.doc_id, lang, topic_label, label_source FROM rec LEFT JOIN documents USING (doc_id)")
def e6(spark, sf):
    k = F.col("doc_id") % 4
    pre = table(spark, sf, "labels").withColumns({"llm_label": F.when(k == 0, "E").when(k == 1, "G").when(k == 2, "Other"), "llm_confidence": (F.col("doc_id") % 10).cast("double") / 10, "rule_label": F.when(F.col("quality") == 1, "E").otherwise("G")})
    return labels.hybrid(pre, table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "topic_label", "label_source")


@query("e8_agreement", _PAIR + ", g AS (SELECT label_source, count(*) AS n FROM rec GROUP BY ALL) SELECT label_source, n, round(n / greatest(sum(n) FILTER (WHERE label_source <> 'none') OVER (), 1) * 100, 6) AS pct FROM g")
def e8(spark, sf):
    return labels.agreement(_pair(spark, sf))


@query(
    "e9_kappa",
    """WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE x = y) AS s FROM c),
  p AS (SELECT sum(r * k) AS rk FROM (SELECT x, sum(n) AS r FROM c GROUP BY x) JOIN (SELECT y AS x, sum(n) AS k FROM c GROUP BY y) USING (x))
  SELECT CAST(n AS BIGINT) AS n, round(s / n, 6) AS raw_agreement, round((s / n - rk / n / n) / (1 - rk / n / n), 6) AS kappa FROM t, p""",
)
def e9(spark, sf):
    return labels.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("e10_confident", _PAIR + " SELECT topic_label, count(*) AS n FROM rec WHERE topic_confidence >= CAST(0.5 AS DOUBLE) GROUP BY ALL")
def e10(spark, sf):
    return labels.confident(_pair(spark, sf)).groupBy("topic_label").agg(F.count("*").alias("n"))


@query(
    "e11_split",
    """WITH x AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)
  SELECT doc_id, lang, CASE WHEN r <= round(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN r <= round(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM x""",
)
def e11(spark, sf):
    return labels.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("e12_subsets", ACTION + " SELECT action_label, count(*) AS n FROM act WHERE topic_label <> 'Non_ESG' AND action_label IN ('Implemented', 'Planning', 'Indeterminate') GROUP BY ALL")
def e12(spark, sf):
    return labels.action_subset(labels.esg_subset(actions(spark, sf))).groupBy("action_label").agg(F.count("*").alias("n"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, which goes when the session's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return f"{folder}/data"


@query("a5_parquet", "SELECT doc_id, lang, source, n_chars, md5(text) AS h FROM documents")
def a5(spark, sf):
    """Written by (bank, year) and read again."""
    path = f"{scratch(spark)}.parquet"
    whole = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.coalesce("source", F.lit("none")).alias("bank"), F.lit(2020).alias("year"))
    tables.write_parquet(whole, path, by_document=True)
    return tables.read_table(spark, path).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"))


@query("a7_csv", "SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents")
def a7(spark, sf):
    """Texts with quotes, commas and line feeds through CSV and back."""
    path = f"{scratch(spark)}.csv"
    tables.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    d = tables.read_table(spark, path)
    return d.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))


@query("e3_batches", SENT + r" SELECT bank, count(*) AS n FROM sent WHERE NOT regexp_matches(sentence, '<!-- image -->|^\d+$') AND length(sentence) >= 20 GROUP BY bank")
def e3(spark, sf):
    """All labelled in batches, in two goes."""
    path, s = scratch(spark), sentences(spark, sf).select("sent_id", "bank", "sentence")
    label = lambda d: d.select("sent_id", "bank")
    label_batches(s.where("length(sentence) % 3 = 0"), label, path, 20_000)
    label_batches(s, label, path, 20_000)
    return spark.read.parquet(path).groupBy("bank").agg(F.count("*").alias("n"))


@query("f1_has", SENT + " SELECT bank, count(*) FILTER (WHERE regexp_matches(sentence, '(?i)the|[0-9]+%')) AS n FROM sent GROUP BY bank")
def f1(spark, sf):
    return sentences(spark, sf).groupBy("bank").agg(F.count_if(has("sentence", "the|[0-9]+%")).alias("n"))


def _truth_sql(kb) -> str:
    return ", ".join("least(CAST(0.5 AS DOUBLE) * (" + " + ".join(f"CASE WHEN regexp_matches(lower(sentence), {_q(p)}) THEN 1 ELSE 0 END" for p in c.rule.patterns) + f"), 1) AS t{i}" for i, c in enumerate(kb.rules))


def _of_label(kb, k) -> list[str]:
    return [f"t{i}" for i, c in enumerate(kb.rules) if c.kind == "implication" and c.target == k]


TRUTH = SENT + f", tr AS (SELECT *, {_truth_sql(TOPIC_KB)} FROM sent)"


@query("f4_label_truth", TRUTH + " SELECT sent_id, " + ", ".join((f"greatest({', '.join(_of_label(TOPIC_KB, k))})" if len(_of_label(TOPIC_KB, k)) > 1 else (_of_label(TOPIC_KB, k) or ["CAST(0 AS DOUBLE)"])[0]) + f" AS {k}" for k in TOPIC_KB.labels) + " FROM tr")
def f4(spark, sf):
    return neuro.truths(sentences(spark, sf), TOPIC_KB).select("sent_id", *(c.alias(k) for k, c in neuro.label_truth(TOPIC_KB).items()))


@query("f5_active", TRUTH + " SELECT sent_id, 1 + " + " + ".join(f"CASE WHEN t{i} > 0 THEN 1 ELSE 0 END" for i in range(len(TOPIC_KB.rules))) + " AS n, 1 + " + " + ".join(f"t{i}" for i in range(len(TOPIC_KB.rules))) + " AS total FROM tr")
def f5(spark, sf):
    a = neuro.active(TOPIC_KB)
    return neuro.truths(sentences(spark, sf), TOPIC_KB).select("sent_id", F.size(a).alias("n"), F.aggregate(a, dbl(0), lambda s, c: s + c["truth"]).alias("total"))


@query("f6_triggered", TRUTH + " SELECT sent_id, " + ", ".join("concat_ws(',', " + ", ".join([f"CASE WHEN t{i} > 0 THEN {_q(f'{c.rule.name} ({c.source})')} END" for i, c in enumerate(TOPIC_KB.rules) if c.kind == "implication" and c.target == k] or ["NULL"]) + f") AS {k}" for k in TOPIC_KB.labels) + " FROM tr")
def f6(spark, sf):
    t = neuro.triggered(TOPIC_KB)
    return neuro.truths(sentences(spark, sf), TOPIC_KB).select("sent_id", *(F.concat_ws(",", t[k]).alias(k) for k in TOPIC_KB.labels))


def _rule_score(kb, k) -> str:
    return " + ".join([_d(0.0)] + [("" if c.kind == "implication" else "-1 * ") + f"t{i}" for i, c in enumerate(kb.rules) if c.target == k])


_K = len(TOPIC_KB.labels)
_lg = [f"CAST((doc_id * {k + 3} + pos * 11) % 17 AS DOUBLE) / 5" for k in range(_K)]
_cols = lambda p: [f"{p}{k}" for k in range(_K)]
_lse = lambda p: f"greatest({', '.join(_cols(p))}) + ln({' + '.join(f'exp({c} - greatest({", ".join(_cols(p))}))' for c in _cols(p))})"
FUSED = TRUTH + f""",
f0 AS (SELECT *, {", ".join(f"{x} AS g{k}" for k, x in enumerate(_lg))}, {", ".join(f"{_rule_score(TOPIC_KB, n)} AS u{k}" for k, n in enumerate(TOPIC_KB.labels))} FROM tr),
f1 AS (SELECT *, {_lse("g")} AS lg, {_lse("u")} AS lu FROM f0),
f2 AS (SELECT *, {", ".join(f"CAST(0.5 AS DOUBLE) * (g{k} - lg) + CAST(0.5 AS DOUBLE) * (u{k} - lu) AS c{k}" for k in range(_K))} FROM f1),
f3 AS (SELECT *, {_lse("c")} AS lc FROM f2)"""
_amax = lambda p: "CASE " + " ".join(f"WHEN round({p}{k}, 12) = round(greatest({', '.join(_cols(p))}), 12) THEN {_q(n)}" for k, n in enumerate(TOPIC_KB.labels)) + " END"


@query("f7_rule_log_probs", FUSED + " SELECT sent_id, " + ", ".join(f"round(u{k} - lu, 6) AS r{k}" for k in range(_K)) + " FROM f3")
def f7(spark, sf):
    r = neuro.rule_log_probs(TOPIC_KB)
    return neuro.truths(sentences(spark, sf), TOPIC_KB).withColumn("r", r).select("sent_id", *(F.col("r")[k].alias(f"r{k}") for k in range(_K)))


@query("f8_fusion", FUSED + f" SELECT round(exp(greatest({', '.join(_cols('c'))}) - lc), 6) AS confidence, round(exp(greatest({', '.join(_cols('g'))}) - lg), 6) AS neural_confidence, {_amax('g')} AS neural_label, sent_id FROM f3")
def f8(spark, sf):
    return fused(spark, sf).select("sent_id", "confidence", "neural_label", "neural_confidence")


_adjusted = f"{_amax('c')} <> {_amax('g')}"
_over = " + ".join(f"CASE WHEN t{i} > CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END" for i in range(len(TOPIC_KB.rules)))


@query("f8_explanations", FUSED + f" SELECT sent_id, {_amax('c')} AS label, {_adjusted} AS rule_adjusted, greatest(1, CASE WHEN {_adjusted} THEN 1 ELSE 0 END + {_over}) AS n FROM f3")
def f8x(spark, sf):
    return neuro.explain(fused(spark, sf), TOPIC_KB).select("sent_id", "label", "rule_adjusted", F.size("explanations").alias("n"))


def _fused_sql(kb, alpha: str, source: str) -> str:
    """f3-like rows z over ``source``, with c0.., lc for the fusion and g0.., lg for the model alone."""
    k = len(kb.labels)
    lse = lambda x: f"greatest({', '.join(f'{x}{i}' for i in range(k))}) + ln({' + '.join(f'exp({x}{i} - greatest({", ".join(f"{x}{j}" for j in range(k))}))' for i in range(k))})"
    return (
        f"z0 AS (SELECT *, {_truth_sql(kb)} FROM {source}), z1 AS (SELECT *, {', '.join(f'CAST((doc_id * {i + 3} + pos * 11) % 17 AS DOUBLE) / 5 AS g{i}' for i in range(k))}, {', '.join(f'{_rule_score(kb, n)} AS u{i}' for i, n in enumerate(kb.labels))} FROM z0), "
        f"z2 AS (SELECT *, {lse('g')} AS lg, {lse('u')} AS lu FROM z1), z3 AS (SELECT *, {', '.join(f'(1 - {alpha}) * (g{i} - lg) + {alpha} * (u{i} - lu) AS c{i}' for i in range(k))} FROM z2), z AS (SELECT *, {lse('c')} AS lc FROM z3)"
    )


def _arg_sql(kb, x: str) -> str:
    all_ = ", ".join(f"{x}{i}" for i in range(len(kb.labels)))
    return "CASE " + " ".join(f"WHEN round({x}{i}, 12) = round(greatest({all_}), 12) THEN {_q(n)}" for i, n in enumerate(kb.labels)) + " END"


def _f1_sql(rows: str, truth: str, predicted: str, keys: str = "") -> str:
    """macro_f1 and micro_f1 of ``rows`` by ``keys``."""
    k, on = (f"{keys}, ", f" USING ({keys})") if keys else ("", " ON TRUE")
    return (
        f"SELECT {k}avg(CASE WHEN su + pr > 0 THEN 2 * tp / (su + pr) ELSE 0 END) AS macro_f1, 2 * sum(tp) / sum(su + pr) AS micro_f1 FROM (SELECT {k}label, coalesce(sum(n) FILTER (WHERE t = label AND p = label), 0) AS tp, coalesce(sum(n) FILTER (WHERE t = label), 0) AS su, coalesce(sum(n) FILTER (WHERE p = label), 0) AS pr "
        f"FROM (SELECT {k}{truth} AS t, {predicted} AS p, count(*) AS n FROM {rows} GROUP BY ALL) c JOIN (SELECT DISTINCT {k}unnest([{truth}, {predicted}]) AS label FROM {rows}) l{on} GROUP BY {k}label)" + (f" GROUP BY {keys}" if keys else "")
    )


_PROB = ", ".join(f"exp(g{k} - lg) AS p{k}" for k in range(_K))
_clp = lambda k: f"least(greatest(p{k}, CAST(1e-7 AS DOUBLE)), CAST({1 - 1e-7!r} AS DOUBLE))"
_imp = [(i, TOPIC_KB.labels.index(c.target)) for i, c in enumerate(TOPIC_KB.rules)]


@query(
    "f12_semantic_loss",
    FUSED + f""", pr AS (SELECT *, {_PROB} FROM f3), lo AS (SELECT -ln({" * ".join(f"(1 - {_clp(k)})" for k in range(_K))} * ({" + ".join(f"{_clp(k)} / (1 - {_clp(k)})" for k in range(_K))}) + CAST(1e-7 AS DOUBLE)) AS eo,
  {" + ".join(f"CASE WHEN t{i} > 0 THEN -t{i} * ln(greatest(p{k}, CAST(1e-7 AS DOUBLE))) ELSE 0 END" for i, k in _imp)} AS im, {" + ".join(f"CASE WHEN t{i} > 0 THEN 1 ELSE 0 END" for i, _ in _imp)} AS n FROM pr)
  SELECT round(avg(eo), 6) AS exactly_one, round(sum(im) / sum(n), 6) AS implication, CAST(0 AS DOUBLE) AS negation, round(avg(eo) + CAST(0.5 AS DOUBLE) * sum(im) / sum(n), 6) AS total FROM lo""",
)
def f12(spark, sf):
    from veridicta.functions.expressions import softmax

    d = neuro.truths(logits(sentences(spark, sf), 6), TOPIC_KB).withColumn("probs", softmax(F.col("logits")))
    return neuro.semantic_loss(d, TOPIC_KB)


def _act_losses(kind: str, out: str) -> str:
    some = [(i, ACTION_KB.labels.index(c.target)) for i, c in enumerate(ACTION_KB.rules) if c.kind == kind]
    p = lambda k: f"p{k}" if kind == "implication" else f"(1 - p{k})"
    total = " + ".join(f"CASE WHEN t{i} > 0 THEN -t{i} * ln(greatest({p(k)}, CAST(1e-7 AS DOUBLE))) ELSE 0 END" for i, k in some)
    return f"{total} AS {out}, " + " + ".join(f"CASE WHEN t{i} > 0 THEN 1 ELSE 0 END" for i, _ in some) + f" AS {out}_n"


@query("f11_negation", SENT + ", " + _fused_sql(ACTION_KB, "CAST(0.5 AS DOUBLE)", "sent") + f""", pr AS (SELECT *, {", ".join(f"exp(g{k} - lg) AS p{k}" for k in range(3))} FROM z),
  lo AS (SELECT -ln({" * ".join(f"(1 - {_clp(k)})" for k in range(3))} * ({" + ".join(f"{_clp(k)} / (1 - {_clp(k)})" for k in range(3))}) + CAST(1e-7 AS DOUBLE)) AS eo, {_act_losses("implication", "im")}, {_act_losses("negation", "ne")} FROM pr)
  , av AS (SELECT avg(eo) AS exactly_one, coalesce(sum(im) / nullif(sum(im_n), 0), 0) AS implication, coalesce(sum(ne) / nullif(sum(ne_n), 0), 0) AS negation FROM lo)
  SELECT {_r("exactly_one", "implication", "negation")}, round(CAST(0.3 AS DOUBLE) * (exactly_one + CAST(0.5 AS DOUBLE) * implication + CAST(0.5 AS DOUBLE) * negation), 6) AS total FROM av""")
def f11(spark, sf):
    from veridicta.functions.expressions import softmax

    d = neuro.truths(logits(sentences(spark, sf), 3), ACTION_KB).withColumn("probs", softmax(F.col("logits")))
    return neuro.semantic_loss(d, ACTION_KB, weight=0.3)


@query("f13_reasoner", SENT + ", " + _fused_sql(ACTION_KB, "CAST(0.5 AS DOUBLE)", "sent") + f" SELECT {_arg_sql(ACTION_KB, 'c')} AS label, {_arg_sql(ACTION_KB, 'g')} AS neural_label, count(*) AS n, round(avg(exp(greatest(c0, c1, c2) - lc)), 6) AS confidence FROM z GROUP BY ALL")
def f13(spark, sf):
    r = neuro.Reasoner(TOPIC_KB, ACTION_KB)
    d = r.predict(logits(sentences(spark, sf), 3), "action")
    return d.groupBy("label", "neural_label").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


@query("f16_encode", "SELECT lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS label_id, count(*) AS n FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY ALL")
def f16(spark, sf):
    return labels.encode(table(spark, sf, "documents"), "lang", ("en", "de", "fr")).groupBy("lang", "label_id").agg(F.count("*").alias("n"))


_W = {"inverse": "t / (5 * c)", "sqrt_inverse": "sqrt(t / (5 * c))", "effective": "(1 - CAST(0.9999 AS DOUBLE)) / (1 - pow(CAST(0.9999 AS DOUBLE), c))", "none": "CAST(1 AS DOUBLE)"}


@query(
    "f17_class_weights",
    "WITH l AS (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) AS label), n AS (SELECT label, count(doc_id) AS n FROM l LEFT JOIN documents ON lang = label GROUP BY ALL), c AS (SELECT label, n, greatest(n, 1) AS c, sum(n) OVER () AS t FROM n)"
    + " UNION ALL ".join(f" SELECT '{m}' AS method, label, n, round({x} / sum({x}) OVER () * 5, 6) AS weight FROM c" for m, x in _W.items()),
)
def f17(spark, sf):
    d = table(spark, sf, "documents")
    parts = [labels.class_weights(d, "lang", ("en", "de", "fr", "es", "xx"), m).select(F.lit(m).alias("method"), "label", "n", "weight") for m in _W]
    return reduce(DataFrame.unionByName, parts)


@query(
    "f18_f1",
    """WITH c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT DISTINCT t AS label FROM c UNION SELECT DISTINCT p FROM c),
  s AS (SELECT label, coalesce(sum(n) FILTER (WHERE t = label AND p = label), 0) AS tp, coalesce(sum(n) FILTER (WHERE t = label), 0) AS su, coalesce(sum(n) FILTER (WHERE p = label), 0) AS pr FROM l, c GROUP BY label)
  SELECT round(avg(CASE WHEN su + pr > 0 THEN 2 * tp / (su + pr) ELSE 0 END), 6) AS macro_f1, round(2 * sum(tp) / sum(su + pr), 6) AS micro_f1 FROM s""",
)
def f18(spark, sf):
    return labels.f1_summary(table(spark, sf, "labels"), "quality", "toxic")


@query("f19_rule_coverage", TRUTH + " SELECT round(avg(CASE WHEN " + " + ".join(f"t{i}" for i in range(len(TOPIC_KB.rules))) + " > 0 THEN 1.0 ELSE 0.0 END), 6) AS rule_coverage FROM tr")
def f19(spark, sf):
    return neuro.rule_coverage(fused(spark, sf))


@query("f20_alpha_search", TOPIC + ", ta AS (SELECT *, unnest([CAST(0.3 AS DOUBLE), 0.5, 0.7, 0.9]) AS alpha FROM topic), " + _fused_sql(TOPIC_KB, "alpha", "ta") + f", y AS (SELECT alpha, topic_label, {_arg_sql(TOPIC_KB, 'c')} AS label FROM z), s AS ({_f1_sql('y', 'topic_label', 'label', 'alpha')}) SELECT alpha, {_r('macro_f1', 'micro_f1')}, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, alpha) = 1 AS best FROM s")
def f20(spark, sf):
    d = neuro.truths(logits(topics(spark, sf), 6), TOPIC_KB)
    return neuro.alpha_search(d, TOPIC_KB, "topic_label")


@query("f21_compare", TOPIC + ", " + _fused_sql(TOPIC_KB, "CAST(0.5 AS DOUBLE)", "topic") + f", y AS (SELECT topic_label, {_arg_sql(TOPIC_KB, 'c')} AS label, {_arg_sql(TOPIC_KB, 'g')} AS nl FROM z) SELECT 'baseline' AS run, {_r('macro_f1', 'micro_f1')} FROM ({_f1_sql('y', 'topic_label', 'nl')}) UNION ALL SELECT 'neuro_symbolic', {_r('macro_f1', 'micro_f1')} FROM ({_f1_sql('y', 'topic_label', 'label')})")
def f21(spark, sf):
    return neuro.compare(neuro.truths(logits(topics(spark, sf), 6), TOPIC_KB), TOPIC_KB, "topic_label", 0.5)


@query("f22_surrogate")
def f22(spark, sf):
    d = labels.encode(table(spark, sf, "documents").select("doc_id", "text", "lang").where("text IS NOT NULL"), "lang", ("en", "de", "fr", "es"))
    d = labels.stratified_split(d, "lang", "doc_id")
    model = train_surrogate(d.where("split = 'train'"))
    out = surrogate_logits(model, d.where("split = 'test'"))
    return labels.f1_summary(out.withColumn("p", F.col("prediction").cast("int")), "label_id", "p")


@query("f22_early_stopping")
def f22_early(spark, sf):
    """Languages told from all texts by mini-batches: a row for each epoch until it stops."""
    names = ("en", "de", "fr", "es")
    d = labels.encode(table(spark, sf, "documents").select("doc_id", "text", "lang"), "lang", names)
    d = labels.stratified_split(d, "lang", "doc_id")
    history = minibatch.fit(d.where("split = 'train'"), d.where("split = 'val'"), names, "doc_id", how=minibatch.Settings(batch=1024))[1]
    return spark.createDataFrame([tuple(h.values()) for h in history], "epoch int, loss double, macro_f1 double, micro_f1 double, best boolean")  # a row an epoch


@query("f23_split_scores")
def f23(spark, sf):
    """A model fitted with rules in its loss, saved, loaded, and scored on every split, alone and with the rules."""
    d = actions(spark, sf).select("sent_id", "sentence", "action_label").where("sent_id IS NOT NULL")
    folder = scratch(spark)
    split = labels.stratified_split(labels.encode(d, "action_label", packs.ACTIONS), "action_label", "sent_id").cache()  # read by each pass
    training.train_and_evaluate(split, "action_label", packs.ACTIONS, "sent_id", ACTION_KB, "sentence", folder, steps=10)
    return training.evaluate(training.LinearModel.load(spark, folder), split, "action_label", ACTION_KB, text="sentence")


@query("f24_batch_scores", SENT + " SELECT sent_id, CAST(length(sentence) % 5 AS DOUBLE) AS a, CAST(pos % 3 AS DOUBLE) / 2 AS b FROM sent")
def f24(spark, sf):
    """A model's place taken by lengths; texts reach it in batches."""
    load = lambda: lambda texts: [(len(t.split("|", 1)[1]) % 5, int(t.split("|", 1)[0]) % 3 / 2) for t in texts]
    d = sentences(spark, sf).select("sent_id", F.concat_ws("|", F.col("pos").cast("string"), "sentence").alias("t"))
    return model_scorer(load, 2, "t")(d).select("sent_id", F.col("logits")[0].alias("a"), F.col("logits")[1].alias("b"))


_KPI = ", ".join(f"regexp_extract_all(sentence, {_q('(?i)' + p)}, 1)" for p in packs.SYNTHETIC_KPI_VALUES)


@query("g6_evidence", EVID + " SELECT sent_id, has_evidence, array_to_string(types, ',') AS evidence_types, round(quality, 6) AS quality FROM ev")
def g6(spark, sf):
    return with_evidence(spark, sf).select("sent_id", "has_evidence", "evidence_types", evidence.quality(F.col("evidence_types"), _E).alias("quality"))


@query("g5_kpi_values", SENT + f" SELECT sent_id, array_to_string(list_sort(list_distinct(list_transform(flatten([{_KPI}]), lambda x: trim(x, ' '))))[1:10], ',') AS kpi_values FROM sent")
def g5(spark, sf):
    return sentences(spark, sf).select("sent_id", evidence.kpi_values("sentence", packs.SYNTHETIC_KPI_VALUES).alias("kpi_values"))


@query("g3_matches", SENT + " SELECT sent_id, " + ", ".join("array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(sentence, {_q('(?i)' + x)}, {1 if '(' in x else 0})" for x in e.patterns) + f"])))[1:5], '|') AS {e.name}" for e in _E) + " FROM sent")
def g3(spark, sf):
    m = evidence.matches_of("sentence", _E)
    return sentences(spark, sf).withColumn("m", m).select("sent_id", *(F.concat_ws("|", F.col("m")[e.name]).alias(e.name) for e in _E))


@query("h3_window_candidates", LINK + " SELECT bank, claim, evidence, round(boost, 6) AS boost FROM win")
def h3(spark, sf):
    return linking.window_candidates(linkable(spark, sf)).select("bank", "claim", "evidence", "boost")


@query("h4_tfidf", TFIDF + " SELECT bank, pos, count(*) AS n, round(sum(weight), 6) AS total FROM tfidf GROUP BY bank, pos")
def h4(spark, sf):
    return linking.tfidf(linkable(spark, sf)).groupBy("bank", "pos").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query(
    "h5_tfidf_candidates",
    TFIDF + """, dot AS (SELECT a.bank, a.pos AS claim, b.pos AS evidence, sum(a.weight * b.weight) AS sim FROM tfidf a JOIN tfidf b ON a.bank = b.bank AND a.term = b.term GROUP BY ALL),
  al AS (SELECT x.bank, x.sent_pos AS claim, y.sent_pos AS evidence, coalesce(sim, 0) AS sim FROM l x JOIN l y ON x.bank = y.bank JOIN n ON n.bank = x.bank AND n.n > 10 LEFT JOIN dot ON dot.bank = x.bank AND dot.claim = x.sent_pos AND dot.evidence = y.sent_pos),
  rk AS (SELECT *, row_number() OVER (PARTITION BY bank, claim ORDER BY round(sim, 9) DESC, evidence) AS r FROM al)
  SELECT bank, claim, count(*) AS n, round(sum(CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * sim), 6) AS boost FROM rk WHERE r <= 21 AND abs(claim - evidence) > 5 GROUP BY bank, claim""",
)
def h5(spark, sf):
    c = linking.tfidf_candidates(linkable(spark, sf))
    return c.groupBy("bank", "claim").agg(F.count("*").alias("n"), F.sum("boost").alias("boost"))


@query("h6_candidates", TFIDF + ", " + _SIM + " SELECT bank, way, count(*) AS n, round(sum(boost), 6) AS boost FROM (SELECT bank, boost, 'window' AS way FROM win UNION ALL SELECT bank, boost, 'document' FROM dc) GROUP BY bank, way")
def h6(spark, sf):
    return linking.candidates(linkable(spark, sf)).groupBy("bank", "way").agg(F.count("*").alias("n"), F.sum("boost").alias("boost"))


@query("h7_cosine", LINK + " SELECT a.bank, a.sent_pos AS pos, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM l a JOIN l b ON a.bank = b.bank AND b.sent_pos = a.sent_pos + 1")
def h7(spark, sf):
    d = linkable(spark, sf)
    nxt = d.select("bank", (F.col("sent_pos") - 1).alias("sent_pos"), F.col("embedding").alias("w"))
    return d.join(nxt, ["bank", "sent_pos"]).select("bank", F.col("sent_pos").alias("pos"), cosine(F.col("embedding"), F.col("w")).alias("similarity"))


@query("h12_link_window", WINLINK + f" SELECT bank, sent_pos, best_evidence_pos, {_r('similarity_score', 'avg_similarity', 'nli_entailment_score')}, num_evidence, search_method, nli_label FROM linked")
def h12(spark, sf):
    d = linking.link(linkable(spark, sf), linking.VARIANTS[1])
    return d.select("bank", "sent_pos", "best_evidence_pos", "similarity_score", "avg_similarity", "nli_entailment_score", "num_evidence", "search_method", "nli_label")


_LETTERS = "etaoinsr"
_counts = ", ".join(f"CAST(len(lower(sentence)) - len(replace(lower(sentence), '{x}', '')) AS DOUBLE)" for x in _LETTERS)
LINK_SENT = SENT + f""",
l0 AS (SELECT bank || '-' || year AS bank, 2020 AS year, doc_id, pos, [CAST(1.37 AS DOUBLE), {_counts}] AS v, sentence FROM sent WHERE bank IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY bank, year ORDER BY doc_id, pos) - 1 AS sent_pos, list_filter([{_found}], lambda x: x IS NOT NULL) AS types FROM l0),
""" + LINK[LINK.index("win AS") :]  # fmt: skip


def linkable_sentences(spark, sf):
    """All sentences as claims of their (source, year), in the order of their texts, with letter counts and a constant as vectors."""
    d = sentences(spark, sf).where("bank IS NOT NULL").select(F.concat_ws("-", "bank", F.col("year").cast("string")).alias("bank"), F.lit(2020).alias("year"), "doc_id", "pos", "sentence")
    s = F.lower("sentence")
    d = d.withColumn("embedding", F.array(dbl(1.37), *((F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS)))
    return evidence.detect(corpus.with_position(d, "doc_id", "pos", by=("bank", "year")), "sentence", pack=_E, kpis=packs.SYNTHETIC_KPI_VALUES)


@query("h12_link_sentences", WINLINK.replace(LINK, LINK_SENT) + f" SELECT bank, sent_pos, best_evidence_pos, {_r('similarity_score', 'avg_similarity', 'nli_entailment_score')}, num_evidence, search_method, nli_label FROM linked")
def h12s(spark, sf):
    d = linking.link(linkable_sentences(spark, sf), linking.VARIANTS[1])
    return d.select("bank", "sent_pos", "best_evidence_pos", "similarity_score", "avg_similarity", "nli_entailment_score", "num_evidence", "search_method", "nli_label")


@query("i6_fitted_entailment")
def i6(spark, sf):
    """All sentences against the next of their text, by a scorer fitted on pairs made of a bounded sample of them."""
    d = sentences(spark, sf)
    model = vectors.fit(d)
    scorer = entailment.fit(entailment.made_pairs(entailment.sample(d, "sentence"), model), model).scorer()
    judged = scorer(d.where("ctx_next <> ''").select("bank", F.col("ctx_next").alias("evidence_text"), F.col("sentence").alias("claim_text")))
    return judged.groupBy("bank", "nli_label").agg(F.count("*").alias("n"), F.avg("entailment").alias("entailment"))


@query("h13_link_nli", TFIDF + ", " + _SIM + ", " + _linked_sql("nl", True) + " SELECT bank, sent_pos, best_evidence_pos, round(similarity_score, 6) AS similarity_score, num_evidence, search_method, nli_label, round(nli_entailment_score, 6) AS nli_entailment_score FROM nl")
def h13(spark, sf):
    d = linking.link(linkable(spark, sf), linking.VARIANTS[0])
    return d.select("bank", "sent_pos", "best_evidence_pos", "similarity_score", "num_evidence", "search_method", "nli_label", "nli_entailment_score")


@query(
    "h15_summary",
    WINLINK + """ SELECT 'window' AS evidence_variant, count(*) AS rows, round(avg(CASE WHEN has_evidence THEN 1.0 ELSE 0.0 END), 6) AS evidence_rate, round(avg(similarity_score), 6) AS avg_similarity, round(avg(nli_entailment_score), 6) AS avg_nli_entailment,
  CAST(0 AS DOUBLE) AS entailment_share, CAST(0 AS DOUBLE) AS contradiction_share, CAST(1 AS DOUBLE) AS neutral_share, round(avg(CASE WHEN sent_pos % 3 = 0 AND NOT has_evidence THEN 1.0 ELSE 0.0 END), 6) AS high_risk_rate FROM linked""",
)
def h15(spark, sf):
    return linking.summarize(linking.link(linkable(spark, sf), linking.VARIANTS[1]))


@query("h16_variants", TFIDF + WINLINK.removeprefix(LINK) + ", " + _SIM + ", " + _linked_sql("nl", True) + ", " + _linked_sql("nn", False) + " " + " UNION ALL ".join(_summary_sql(v, r) for v, r in (("nli", "nl"), ("window", "linked"), ("no_nli", "nn"))))
def h16(spark, sf):
    return linking.summarize(linking.link_all(linkable(spark, sf)))


@query("h1_embed")
def h1(spark, sf):
    d = hashed_embeddings(sentences(spark, sf))
    return d.groupBy("bank").agg(F.avg(F.aggregate("embedding", dbl(0), lambda s, x: s + F.abs(x))).alias("mean_size"))


@query("h1_vectors")
def h1_vectors(spark, sf):
    """Vectors fitted on all sentences: how near each sentence is to the next one of its text."""
    d = sentences(spark, sf).select("bank", "sentence", "ctx_next")
    model = vectors.fit(d)
    d = vectors.nearness(d, model, {"near_next": ("sentence", "ctx_next"), "known": ("sentence", "sentence")})
    return d.groupBy("bank").agg(F.count("*").alias("n"), F.avg("near_next").alias("near_next"), F.avg("known").alias("known"))


@query(
    "i1_nli_batches",
    """WITH x AS (SELECT conv_id, turn, CAST(turn % 3 AS DOUBLE) AS c, CAST(coalesce(length(text), 0) % 5 AS DOUBLE) / 2 AS n, CAST(coalesce(length(text), 0) % 2 AS DOUBLE) AS e FROM conversations),
  y AS (SELECT *, exp(c) + exp(n) + exp(e) AS t FROM x)
  SELECT conv_id, turn, CASE WHEN c = greatest(c, n, e) THEN 'contradiction' WHEN n = greatest(c, n, e) THEN 'neutral' ELSE 'entailment' END AS nli_label, round(exp(e) / t, 6) AS entailment, round(exp(c) / t, 6) AS contradiction, round(exp(n) / t, 6) AS neutral FROM y""",
)
def i1(spark, sf):
    """A model's place taken by lengths."""
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("evidence_text"), F.col("turn").cast("string").alias("claim_text"))
    load = lambda: lambda pairs: [(int(b) % 3, len(a) % 5 / 2, len(a) % 2) for a, b in pairs]
    return nli_scorer(load)(d).select("conv_id", "turn", "nli_label", "entailment", "contradiction", "neutral")


@query("i4_nli_fallback", "SELECT count(*) AS n, 'neutral' AS nli_label, CAST(0.3 AS DOUBLE) AS entailment, CAST(0.2 AS DOUBLE) AS contradiction, CAST(0.5 AS DOUBLE) AS neutral FROM conversations")
def i4(spark, sf):
    """A model that fails on every batch."""
    d = table(spark, sf, "conversations").select(F.col("text").alias("evidence_text"), F.col("role").alias("claim_text"))

    def broken():
        def predict(pairs):
            raise RuntimeError("no model")

        return predict

    return nli_scorer(broken)(d).groupBy("nli_label", "entailment", "contradiction", "neutral").agg(F.count("*").alias("n"))


@query("i2_nli_label", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' ELSE 'neutral' END AS label FROM conversations")
def i2(spark, sf):
    k = F.col("turn") % 3
    return table(spark, sf, "conversations").select("conv_id", "turn", linking.normalize_nli_label(F.when(k == 0, "ENTAIL").when(k == 1, "Contradiction_x").otherwise("is_Neutral")).alias("label"))


@query(
    "i3_nli_decision",
    """WITH x AS (SELECT conv_id, turn, turn % 3 AS c, (turn + 1) % 3 AS n, turn % 2 AS e FROM conversations)
  SELECT conv_id, turn, CASE WHEN c = greatest(c, n, e) THEN 'contradiction' WHEN n = greatest(c, n, e) THEN 'neutral' ELSE 'entailment' END AS label FROM x""",
)
def i3(spark, sf):
    t = F.col("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", linking.nli_decision(t % 3, (t + 1) % 3, t % 2).alias("label"))


@query("j5_sentence_risk", SCORED + f" SELECT sent_id, {_r('sim_doc_mean', 'sim_doc_std', 'es_combined', 'wrs', 'wrs_old')} FROM scored")
def j5(spark, sf):
    return scored(spark, sf).select("sent_id", "sim_doc_mean", "sim_doc_std", "es_combined", "wrs", "wrs_old")


_BY_D = ("implemented_ratio", "planning_ratio", "indeterminate_ratio", "evidence_ratio", "avg_evidence_strength", "ewri", "ewri_old", "contrib_implemented", "contrib_planning", "contrib_indeterminate", "topic_entropy")
_BY_N = ("bank", "year", "total_sentences", "implemented", "planning", "indeterminate", "with_evidence", "without_evidence", "risk_level")


@query("j11_bank_years", BY + f" SELECT {', '.join(_BY_N)}, {_r(*_BY_D)} FROM bys")
def j11(spark, sf):
    return scores(spark, sf).select(*_BY_N, *_BY_D)


_UNITS = {c: 2 for c in risk._TWO} | {c: 3 for c in risk._THREE if c != "topic_coverage_index"}


@query("j14_rounded", BY + f" SELECT bank, year, risk_level, {len(_UNITS)} AS within FROM bys")
def j14(spark, sf):
    """Published precision: every figure within half a unit of the unrounded one, the level from the latter."""
    exact = scores(spark, sf)
    flat = risk.rounded(exact).select("bank", "year", "risk_level", *(F.col(c).alias(f"r_{c}") for c in _UNITS))
    near = sum((F.when(F.abs(F.col(c) - F.col(f"r_{c}")) <= 0.5 * 10.0**-n + 1e-9, 1).otherwise(0) for c, n in _UNITS.items()), F.lit(0))
    return exact.drop("risk_level").join(flat, ["bank", "year"]).select("bank", "year", "risk_level", near.alias("within"))


_TB = """, g AS (SELECT bank, year, topic_label AS topic, count(*) AS n, avg(wrs) * 100 AS e, avg(CASE WHEN action_label = 'Implemented' THEN 1.0 ELSE 0.0 END) * 100 AS i, avg(CASE WHEN has_evidence THEN 1.0 ELSE 0.0 END) * 100 AS v FROM scored WHERE bank IS NOT NULL GROUP BY ALL),
grid AS (SELECT bank, year, topic FROM (SELECT DISTINCT bank, year FROM scored WHERE bank IS NOT NULL), (SELECT unnest(['E', 'S_labor', 'S_community', 'S_product', 'G']) AS topic)),
tb AS (SELECT bank, year, topic, coalesce(n, 0) AS n, CASE WHEN n >= 3 THEN e END AS ewri, CASE WHEN n >= 3 THEN i END AS implemented_pct, CASE WHEN n >= 3 THEN v END AS evidence_rate FROM grid LEFT JOIN g USING (bank, year, topic))"""


@query("j10_topic_breakdown", SCORED + _TB + f" SELECT bank, year, topic, n, {_r('ewri', 'implemented_pct', 'evidence_rate')}, CASE WHEN n >= 3 THEN {_lvl('ewri')} ELSE 'N/A' END AS risk_level FROM tb")
def j10(spark, sf):
    return risk.topic_breakdown(scored(spark, sf)).drop("indeterminate_pct")


@query("j13_traceability", SCORED + f", x AS (SELECT bank, year, sent_id, sent_pos, {_dec('wrs', 3)} AS washing_risk, {_dec('es_combined', 3)} AS evidence_strength FROM scored WHERE bank IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY bank, year ORDER BY washing_risk DESC, sent_pos) AS rank FROM x) SELECT bank, year, rank, sent_id, washing_risk, evidence_strength FROM y WHERE rank <= 10")
def j13(spark, sf):
    return risk.sentence_risks(scored(spark, sf), top=10).select("bank", "year", "rank", "sent_id", "washing_risk", "evidence_strength")


@query("j15_summary", BY + f", x AS (SELECT count(*) AS n, min(ewri) AS ewri_min, max(ewri) AS ewri_max, avg(ewri) AS ewri_mean, stddev_samp(ewri) AS ewri_std, avg(ewri_old) AS ewri_old_mean, corr(ewri, ewri_old) AS pearson FROM bys) SELECT n, {_r('ewri_min', 'ewri_max', 'ewri_mean', 'ewri_std', 'ewri_old_mean', 'pearson')} FROM x")
def j15(spark, sf):
    return risk.summary(scores(spark, sf))


_LEG = "(CASE action_label WHEN 'Indeterminate' THEN 2 WHEN 'Planning' THEN 1 ELSE 0 END + (1 - CASE WHEN has_evidence THEN 1 ELSE 0 END)) / 4"


@query(
    "j18_legacy_bank_years",
    EVID + f""", g AS (SELECT bank, year, count(*) AS total_sentences, {_cnt("has_evidence")} AS with_evidence, avg({_LEG}) * 100 AS ewri, {_cnt("action_label = 'Indeterminate'")} / count(*) AS symbolic_ratio,
  {_cnt("action_label = 'Implemented'")} / count(*) AS substantive_ratio FROM ev WHERE bank IS NOT NULL GROUP BY ALL)
  SELECT bank, year, total_sentences, with_evidence, {_r("ewri", "symbolic_ratio", "substantive_ratio")}, {_lvl("ewri", 30, 50, 70)} AS risk_level FROM g""",
)
def j18(spark, sf):
    return risk.legacy_bank_years(with_evidence(spark, sf)).select("bank", "year", "total_sentences", "with_evidence", "ewri", "symbolic_ratio", "substantive_ratio", "risk_level")


_LT = EVID + f""", g AS (SELECT bank, year, topic_label AS topic, count(*) AS n, avg({_LEG}) * 100 AS e FROM ev WHERE bank IS NOT NULL GROUP BY ALL),
grid AS (SELECT bank, year, topic FROM (SELECT DISTINCT bank, year FROM ev WHERE bank IS NOT NULL), (SELECT unnest({list(packs.ESG_TOPICS)}) AS topic)),
tb AS (SELECT bank, year, topic, coalesce(n, 0) AS n, CASE WHEN n >= 3 THEN e END AS ewri FROM grid LEFT JOIN g USING (bank, year, topic))
SELECT bank, year, topic, n, {_r("ewri")}, CASE WHEN n >= 3 THEN {_lvl("ewri", 30, 50, 70)} ELSE 'N/A' END AS risk_level FROM tb"""


@query("j19_legacy_topics", _LT)
def j19(spark, sf):
    return risk.legacy_topics(with_evidence(spark, sf))


@query("j20_legacy_claims", EVID + f", x AS (SELECT bank, year, sent_id, sent_pos, round({_LEG} * 100, 2) AS risk_score FROM ev WHERE bank IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY bank, year ORDER BY risk_score DESC, sent_pos) AS rank FROM x) SELECT bank, year, rank, sent_id, risk_score FROM y WHERE rank <= 10")
def j20(spark, sf):
    return risk.legacy_top_claims(with_evidence(spark, sf)).select("bank", "year", "rank", "sent_id", "risk_score")


@query(
    "k1_decomposition",
    BY + ", m AS (SELECT avg(ewri) AS e FROM bys)" + " UNION ALL ".join(f" SELECT '{a}' AS component, round(avg(contrib_{a.lower()}), 6) AS mean_contribution, round(avg(contrib_{a.lower()}) / any_value(e) * 100, 6) AS pct_of_ewri, round(stddev_samp(contrib_{a.lower()}), 6) AS std FROM bys, m" for a in packs.ACTIONS),
)
def k1(spark, sf):
    return analyses.decomposition(scores(spark, sf)).select("component", "mean_contribution", "pct_of_ewri", "std")


_BIN = "CASE " + " ".join(f"WHEN es_combined >= {_d(a)} AND es_combined < {_d(b)} THEN {_q(n)}" for n, a, b in analyses.ES_BINS) + " END"


@query(
    "k2_action_evidence",
    SCORED + f""", g AS (SELECT action_label, {_BIN} AS es_level, count(*) AS n, avg(wrs) AS w, avg(es_combined) AS e FROM scored GROUP BY ALL), t AS (SELECT count(*) AS t FROM scored),
  grid AS (SELECT * FROM (SELECT unnest({list(packs.ACTIONS)}) AS action_label), (SELECT unnest({[b[0] for b in analyses.ES_BINS]}) AS es_level))
  SELECT action_label, es_level, coalesce(n, 0) AS count, round(coalesce(n, 0) / t * 100, 6) AS pct_of_total, round(w, 6) AS avg_wrs, round(e, 6) AS avg_es FROM grid LEFT JOIN g USING (action_label, es_level), t""",
)
def k2(spark, sf):
    return analyses.action_evidence(scored(spark, sf))


@query(
    "k3_theoretical",
    SCORED + """, th3 AS (SELECT a AS action_label, e AS es, p * (1 - l * e) AS wrs FROM (VALUES ('Implemented', CAST(0.08 AS DOUBLE), CAST(0.8 AS DOUBLE)), ('Planning', CAST(0.3 AS DOUBLE), CAST(0.65 AS DOUBLE)), ('Indeterminate', CAST(0.55 AS DOUBLE), CAST(0.5 AS DOUBLE))) x(a, p, l),
  (SELECT unnest([CAST(0 AS DOUBLE), 0.25, 0.5, 0.75, 1.0]) AS e)), seen AS (SELECT action_label, round(round(es_combined, 9) * 4) / 4 AS es, count(*) AS n, avg(wrs) AS w FROM scored GROUP BY ALL)
  SELECT action_label, es, round(th3.wrs, 6) AS wrs, coalesce(n, 0) AS n, round(w, 6) AS avg_wrs FROM th3 LEFT JOIN seen USING (action_label, es)""",
)
def k3(spark, sf):
    return analyses.theory_and_sentences(scored(spark, sf))


@query(
    "k4_topic_summary",
    SCORED + f""", g AS (SELECT topic_label AS topic, count(*) AS n, avg(wrs) * 100 AS ewri, avg(CASE WHEN has_evidence THEN 1.0 ELSE 0.0 END) * 100 AS evidence_rate, avg(es_combined) AS avg_evidence_strength FROM scored GROUP BY ALL),
  x AS (SELECT t.topic, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN ewri END AS ewri, CASE WHEN n >= 5 THEN evidence_rate END AS evidence_rate, CASE WHEN n >= 5 THEN avg_evidence_strength END AS avg_evidence_strength FROM (SELECT unnest({list(packs.ESG_TOPICS)}) AS topic) t LEFT JOIN g USING (topic))
  SELECT topic, n, {_r("ewri", "evidence_rate", "avg_evidence_strength")} FROM x""",
)
def k4(spark, sf):
    return analyses.topic_summary(scored(spark, sf)).select("topic", "n", "ewri", "evidence_rate", "avg_evidence_strength")


_DOM = "CASE " + " ".join(f"WHEN n_{t} > 0 AND n_{t} = greatest({', '.join(_ns)}) THEN '{t}'" for t in packs.ESG_TOPICS) + " ELSE 'N/A' END"


@query("k4_bank_topics", TOPIC + f", g AS (SELECT bank, {', '.join(_cnt(f'topic_label = {_q(t)}') + f' AS n_{t}' for t in packs.ESG_TOPICS)} FROM topic WHERE bank IS NOT NULL GROUP BY bank) SELECT bank, {', '.join(_ns)}, round({_entropy_sql(_ns)}, 6) AS entropy, {_DOM} AS dominant_topic FROM g")
def k4b(spark, sf):
    return analyses.bank_topics(topics(spark, sf))


@query("k4_topic_actions", ACTION + " SELECT topic_label AS topic, " + ", ".join(f"round(avg(CASE WHEN action_label = '{a}' THEN 1.0 ELSE 0.0 END) * 100, 6) AS {a.lower()}_pct" for a in packs.ACTIONS) + " FROM act WHERE topic_label <> 'Non_ESG' GROUP BY ALL")
def k4c(spark, sf):
    return analyses.topic_actions(actions(spark, sf))


@query("k5_yearly", BY + ", x AS (SELECT year, avg(ewri) AS ewri_mean, stddev_samp(ewri) AS ewri_std, min(ewri) AS ewri_min, max(ewri) AS ewri_max, avg(ewri_old) AS ewri_old_mean FROM bys GROUP BY year) SELECT year, " + _r("ewri_mean", "ewri_std", "ewri_min", "ewri_max", "ewri_old_mean") + " FROM x")
def k5(spark, sf):
    return analyses.yearly(scores(spark, sf)).select("year", "ewri_mean", "ewri_std", "ewri_min", "ewri_max", "ewri_old_mean")


@query("k6_trends", BY + ", x AS (SELECT bank, count(*) AS n, max_by(ewri, year) - min_by(ewri, year) AS d FROM bys GROUP BY bank) SELECT bank, round(CASE WHEN n >= 2 THEN d ELSE 0 END, 6) + 0 AS ewri_change, CASE WHEN n < 2 THEN 'insufficient_data' WHEN d < -2 THEN 'improving' WHEN d > 2 THEN 'worsening' ELSE 'stable' END AS trend FROM x")
def k6(spark, sf):
    return analyses.bank_trends(scores(spark, sf)).select("bank", "ewri_change", "trend")


_RANK = ", rk AS (SELECT bank, avg(ewri) AS ewri_mean, stddev_samp(ewri) AS ewri_std, sum(total_sentences) AS total_sentences, avg(evidence_ratio) AS ev_ratio, avg(implemented_ratio) AS impl_ratio, avg(indeterminate_ratio) AS indet_ratio, avg(topic_entropy) AS topic_entropy FROM bys GROUP BY bank)"


@query("k7_ranking", BY + _RANK + f" SELECT bank, row_number() OVER (ORDER BY ewri_mean, bank) AS rank, CAST(total_sentences AS BIGINT) AS total_sentences, {_r('ewri_mean', 'ewri_std', 'ev_ratio', 'topic_entropy')} FROM rk")
def k7(spark, sf):
    return analyses.ranking(scores(spark, sf)).select("bank", "rank", "total_sentences", "ewri_mean", "ewri_std", "ev_ratio", "topic_entropy")


@query(
    "k8_profiles",
    BY + _RANK + """, m AS (SELECT avg(ewri_mean) AS me, avg(ev_ratio) AS mv, avg(impl_ratio) AS mi FROM rk)
  SELECT bank, concat_ws(',', CASE WHEN ewri_mean < me - 2 THEN 'Lower-than-average washing risk' END, CASE WHEN ev_ratio > mv + CAST(0.05 AS DOUBLE) THEN 'Better evidence coverage' END, CASE WHEN impl_ratio > mi + CAST(0.05 AS DOUBLE) THEN 'Higher implementation ratio' END,
    CASE WHEN topic_entropy > CAST(0.85 AS DOUBLE) THEN 'Good topic coverage (diverse ESG reporting)' END) AS strengths,
  concat_ws(',', CASE WHEN ewri_mean > me + 2 THEN 'Higher-than-average washing risk' END, CASE WHEN ev_ratio < mv - CAST(0.05 AS DOUBLE) THEN 'Weak evidence coverage' END, CASE WHEN impl_ratio < mi - CAST(0.05 AS DOUBLE) THEN 'Low implementation ratio' END,
    CASE WHEN indet_ratio > CAST(0.65 AS DOUBLE) THEN 'High proportion of vague claims (>65%)' END, CASE WHEN topic_entropy < CAST(0.65 AS DOUBLE) THEN 'Poor topic coverage (concentrated reporting)' END) AS weaknesses FROM rk, m""",
)
def k8(spark, sf):
    return analyses.profiles(scores(spark, sf)).select("bank", "strengths", "weaknesses")


_SP = [(a, b) for i, a in enumerate(analyses.CORRELATED) for b in analyses.CORRELATED[i + 1 :]]


@query(
    "k9_spearman",
    BY + ", q AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in analyses.CORRELATED) + " FROM bys)"
    + " UNION ALL ".join(f" SELECT '{a}' AS x, '{b}' AS y, round(corr(r_{a}, r_{b}), 6) AS rho FROM q" for a, b in _SP),
)
def k9(spark, sf):
    return analyses.spearman_matrix(scores(spark, sf))


@query(
    "k10_sentence_spearman",
    SCORED + """, q AS (SELECT rank() OVER (ORDER BY round(wrs, 9)) + (count(*) OVER (PARTITION BY round(wrs, 9)) - 1) / 2 AS a, rank() OVER (ORDER BY round(es_combined, 9)) + (count(*) OVER (PARTITION BY round(es_combined, 9)) - 1) / 2 AS b FROM scored)
  SELECT 'wrs' AS x, 'es_combined' AS y, round(corr(a, b), 6) AS rho FROM q""",
)
def k10(spark, sf):
    d = scored(spark, sf).select(F.round("wrs", 9).alias("wrs"), F.round("es_combined", 9).alias("es_combined"))
    return analyses.spearman(d, [("wrs", "es_combined")])


@query(
    "k11_eta_squared",
    SCORED + ", g AS (SELECT action_label, count(*) AS n, avg(wrs) AS m, var_pop(wrs) AS v FROM scored GROUP BY ALL), t AS (SELECT sum(n * m) / sum(n) AS mu FROM g) SELECT round(sum(n * pow(m - mu, 2)) / (sum(n * pow(m - mu, 2)) + sum(n * v)), 6) AS eta_squared FROM g, t",
)
def k11(spark, sf):
    return analyses.eta_squared(scored(spark, sf))


_FC = lambda name, c: f" SELECT '{name}' AS formula, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, round(max({c}) - min({c}), 6) AS range, round(stddev_samp({c}) / greatest(avg({c}), CAST(0.01 AS DOUBLE)) * 100, 6) AS cv FROM bys"


@query("k12_formulas", BY + _FC("old", "ewri_old") + " UNION ALL" + _FC("new", "ewri"))
def k12(spark, sf):
    return analyses.compare_formulas(scores(spark, sf))


@query("k13_distribution", BY + f" SELECT {_lvl('ewri_old')} AS risk_level, count(*) AS n, 'old' AS formula FROM bys GROUP BY ALL UNION ALL SELECT risk_level, count(*) AS n, 'new' FROM bys GROUP BY ALL")
def k13(spark, sf):
    return analyses.risk_distribution(scores(spark, sf))


_IMP = " UNION ALL ".join(
    f" SELECT '{t}' AS type, count(*) FILTER (WHERE list_contains(types, '{t}')) AS count, round(count(*) FILTER (WHERE list_contains(types, '{t}')) / count(*) * 100, 6) AS frequency_pct, round(avg(wrs) FILTER (WHERE list_contains(types, '{t}')), 6) AS avg_wrs_present, round(avg(wrs) FILTER (WHERE NOT list_contains(types, '{t}')), 6) AS avg_wrs_absent FROM scored"
    for t in analyses.EVIDENCE_TYPES
)


@query("k14_evidence_types", SCORED + _IMP)
def k14(spark, sf):
    return analyses.evidence_importance(scored(spark, sf)).drop("risk_reduction_pct")


_EP = [(a, b) for i, a in enumerate(sorted(analyses.EVIDENCE_TYPES)) for b in sorted(analyses.EVIDENCE_TYPES)[i + 1 :]]


@query("k15_cooccurrence", EVID + " UNION ALL ".join(f" SELECT '{a}+{b}' AS pair, count(*) FILTER (WHERE list_contains(types, '{a}') AND list_contains(types, '{b}')) AS count FROM ev" for a, b in _EP))
def k15(spark, sf):
    return analyses.cooccurrence(with_evidence(spark, sf))


_KINDS = {
    "high_risk_pure_washing": ("action_label = 'Indeterminate' AND NOT has_evidence", "DESC"), "suspicious_unsubstantiated": ("action_label = 'Implemented' AND es_combined < CAST(0.15 AS DOUBLE)", "DESC"),
    "medium_risk_planning": ("action_label = 'Planning' AND es_combined > CAST(0.1 AS DOUBLE) AND es_combined < CAST(0.5 AS DOUBLE)", "DESC"), "low_risk_substantive": ("action_label = 'Implemented' AND es_combined > CAST(0.4 AS DOUBLE)", "ASC"),
}


@query("k16_samples", SCORED + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, rank, bank, year, round(wrs, 6) AS washing_risk, substr(sentence, 1, 300) AS sentence FROM (SELECT *, row_number() OVER (ORDER BY a) AS rank FROM (SELECT *, row_number() OVER (ORDER BY wrs {o}, sent_pos) AS a FROM scored WHERE {c}) WHERE a <= 15 AND length(sentence) > 30) WHERE rank <= 5" for k, (c, o) in _KINDS.items()))
def k16(spark, sf):
    return analyses.qualitative_samples(scored(spark, sf)).select("kind", "rank", "bank", "year", "washing_risk", "sentence")


_CLAIMS = f", cl0 AS (SELECT bank, year, sent_id, sent_pos, substr(coalesce(sentence, ''), 1, 250) AS sentence, {_dec('wrs', 3)} AS washing_risk FROM scored WHERE bank IS NOT NULL), cl AS (SELECT *, row_number() OVER (PARTITION BY bank, year ORDER BY washing_risk DESC, sent_pos) AS rank FROM cl0)"


@query(
    "k17_noise_rate",
    SCORED + _CLAIMS + """, f AS (SELECT DISTINCT bank, year FROM cl ORDER BY bank, year LIMIT 10), x AS (SELECT (length(sentence) < 30 OR length(sentence) - length(replace(sentence, ' ', '')) < 3) AS bad FROM cl JOIN f USING (bank, year) WHERE rank <= 10)
  SELECT count(*) AS top_claims_checked, count(*) FILTER (WHERE bad) AS noise_count, round(count(*) FILTER (WHERE bad) / greatest(count(*), 1) * 100, 6) AS noise_rate_pct FROM x""",
)
def k17(spark, sf):
    return analyses.noise_rate(scored(spark, sf))


@query("l1_overview", BY + ", a AS (SELECT count(DISTINCT bank) AS total_banks, count(*) AS total_esg_sentences FROM scored), b AS (SELECT count(*) AS total_bank_years, avg(ewri) AS avg_ewri, min(ewri) AS min_ewri, max(ewri) AS max_ewri, stddev_samp(ewri) AS std_ewri, avg(ewri_old) AS avg_ewri_old FROM bys) SELECT total_banks, total_esg_sentences, total_bank_years, " + _r("avg_ewri", "min_ewri", "max_ewri", "std_ewri", "avg_ewri_old") + " FROM a, b")
def l1(spark, sf):
    return report.overview(scored(spark, sf), scores(spark, sf))


@query("l2_topic_means", SCORED + _TB + """, s AS (SELECT topic_label AS topic, count(*) AS total_sentences, avg(CASE WHEN action_label = 'Implemented' THEN 1.0 ELSE 0.0 END) * 100 AS i FROM scored WHERE topic_label IS NOT NULL GROUP BY ALL)
  SELECT topic, round(avg(CAST(round(CAST(ewri AS DECIMAL(18, 12)), 2) AS DOUBLE)), 6) AS avg_ewri, any_value(total_sentences) AS total_sentences, round(any_value(i), 6) AS implemented_pct FROM tb JOIN s USING (topic) GROUP BY topic""")
def l2(spark, sf):
    return report.topic_summary(scored(spark, sf))


@query("l3_top_claims", SCORED + _CLAIMS + " SELECT row_number() OVER (ORDER BY washing_risk DESC, bank, year, rank) AS place, bank, year, sent_id, washing_risk FROM cl WHERE rank <= 30 ORDER BY place LIMIT 30")
def l3(spark, sf):
    return report.top_claims(scored(spark, sf)).select("place", "bank", "year", "sent_id", "washing_risk")


@query("l4_evidence_statistics", SCORED + " SELECT count(*) FILTER (WHERE has_evidence) AS sentences_with_evidence, printf('%.1f%%', count(*) FILTER (WHERE has_evidence) * 100 / count(*)) AS evidence_rate, round(avg(es_combined), 6) AS mean_evidence_strength FROM scored")
def l4(spark, sf):
    return report.evidence_statistics(scored(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, sentences, rules, evidence, risk and the (bank, year) index, highest first."""
    return r6(risk.rounded(scores(spark, sf)).orderBy(F.col("ewri").desc(), "bank", "year"))
