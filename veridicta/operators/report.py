"""The report: figures, topics, top claims, and how they read."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import rate
from veridicta.operators import analyses
from veridicta.operators.risk import rounded, sentence_risks, topic_breakdown
from veridicta.plans.lineage import settled

DETAILS = 500


def overview(df: DataFrame, scores: DataFrame) -> DataFrame:
    n = df.agg(F.countDistinct("bank").alias("total_banks"), F.count("*").alias("total_esg_sentences"))
    s = scores.agg(
        F.count("*").alias("total_bank_years"), F.avg("ewri").alias("avg_ewri"), F.min("ewri").alias("min_ewri"), F.max("ewri").alias("max_ewri"), F.stddev_samp("ewri").alias("std_ewri"),
        F.avg("ewri_old").alias("avg_ewri_old"),
    )
    return n.join(s)  # one row each


def topic_summary(df: DataFrame) -> DataFrame:
    """Mean over (bank, year) of the topic's rounded index, which is not the mean over sentences."""
    t = topic_breakdown(df).groupBy("topic").agg(F.avg(F.round("ewri", 2)).alias("avg_ewri"))
    n = settled(df, F.col("topic_label").alias("__topic")).where("__topic IS NOT NULL").groupBy(F.col("__topic").alias("topic")).agg(F.count("*").alias("total_sentences"), (rate(F.col("action_label") == "Implemented") * 100).alias("implemented_pct"))
    return t.join(n, "topic")


def top_claims(df: DataFrame, n: int = 30, order: str = "sent_pos") -> DataFrame:
    """The corpus's riskiest sentences; equal ones by bank, year and place."""
    best = sentence_risks(df, order, n)  # no group has more among the first n
    best = best.orderBy(F.col("washing_risk").desc(), "bank", "year", "rank").limit(n)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.col("washing_risk").desc(), "bank", "year", "rank")))


def evidence_statistics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if("has_evidence").alias("sentences_with_evidence"), F.format_string("%.1f%%", F.count_if("has_evidence") * 100 / F.count("*")).alias("evidence_rate"),
        F.avg("es_combined").alias("mean_evidence_strength"),
    )


MOST_ROWS = 100_000


def _rows(df: DataFrame, digits: int = 4) -> list[dict]:
    """For the driver's files: rows by bank and year at most.  More than ``MOST_ROWS`` is an error, not a cut."""
    fix = lambda v: round(v, digits) if isinstance(v, float) else v
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows: write the frame as a table")
    return [{k: fix(v) for k, v in r.asDict(recursive=True).items()} for r in rows]


def build(df: DataFrame, scores: DataFrame, with_analyses: bool = True) -> dict:
    """A small nested dict for the driver: figures, (bank, year) rows, ``DETAILS`` claims; ``scores`` unrounded."""
    flat = rounded(scores)
    details = sentence_risks(df).orderBy(F.col("washing_risk").desc(), "bank", "year", "rank").limit(DETAILS)
    out = {
        "generated_at": datetime.now().strftime("%Y-%m-%d %H:%M:%S"), **_rows(overview(df, flat), 2)[0], "risk_distribution": {r["risk_level"]: r["n"] for r in _rows(flat.groupBy("risk_level").agg(F.count("*").alias("n")))},
        "bank_year_scores": _rows(flat.orderBy(F.col("ewri").desc(), "bank", "year")), "ewri_decomposition": _rows(analyses.decomposition(flat)), "topic_summary": _rows(topic_summary(df)),
        "evidence_stats": _rows(evidence_statistics(df))[0], "top_risk_claims": _rows(top_claims(df)), "sentence_details": _rows(details),
    }
    if with_analyses:
        out["analysis_results"] = {k: _rows(v) for k, v in analyses.run_all(df, flat).items()}
    return out


def text(report: dict) -> str:
    line, rows = "=" * 60, [f"Banks: {report['total_banks']}", f"Bank-years: {report['total_bank_years']}", f"ESG sentences: {report['total_esg_sentences']}"]
    rows += [f"EWRI mean {report['avg_ewri']} ± {report['std_ewri']}, range [{report['min_ewri']}, {report['max_ewri']}]", "", "Risk levels:"]
    rows += [f"  {k}: {n}" for k, n in report["risk_distribution"].items()]
    rows += ["", "Decomposition:"] + [f"  {r['component']}: {r['mean_contribution']:.2f} pts ({r['pct_of_ewri']:.1f}%)" for r in report["ewri_decomposition"]]
    rows += ["", "Topics:"] + [f"  {r['topic']}: n={r['total_sentences']}, EWRI {r['avg_ewri']}" for r in report["topic_summary"]]
    rows += ["", f"Evidence rate: {report['evidence_stats']['evidence_rate']}", "", "Top claims:"]
    rows += [f"  {r['place']}. [{r['bank']} {r['year']}] {r['washing_risk']:.3f} {r['sentence'][:120]}" for r in report["top_risk_claims"]]
    return "\n".join([line, "CLAIM RISK REPORT", line, *rows, ""])


def markdown(results: dict[str, list[dict]]) -> str:
    out = ["# Analysis", ""]
    for name, rows in results.items():
        out += [f"## {name.replace('_', ' ')}", ""]
        if rows:
            keys = list(rows[0])
            out += ["| " + " | ".join(keys) + " |", "|" + "---|" * len(keys)]
            out += ["| " + " | ".join(str(r[k]).replace("|", "\\|").replace("\n", " ") for k in keys) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def as_json(report: dict) -> str:
    return json.dumps(report | {"sentence_details": report.get("sentence_details", [])[:DETAILS]}, ensure_ascii=False, indent=2, default=str)
