"""Recorded (bank, year) figures through the analyses, against the figures recorded for these.

``golden/bank_years.csv`` and the numbers below are fixed values, at published precision."""

from pathlib import Path

import pytest

from veridicta.operators import analyses, report, risk
from veridicta.sources import tables

FORMULAS = {"old": (54.32, 2.85, 3.37, 13.01, 5.3), "new": (36.35, 2.69, 2.88, 14.07, 7.4)}
YEARS = {
    2020: (37.077, 4.129, 31.68, 45.75, 54.922, 0.236, 0.16, 0.308, 0.788), 2021: (35.666, 2.925, 33.29, 41.21, 53.589, 0.269, 0.156, 0.34, 0.833),
    2022: (35.976, 1.789, 33.09, 38.36, 53.936, 0.261, 0.167, 0.326, 0.806), 2023: (36.13, 2.133, 34.37, 41.43, 54.183, 0.241, 0.168, 0.321, 0.782),
    2024: (36.903, 2.078, 33.71, 41.57, 54.953, 0.24, 0.166, 0.302, 0.795),
}
BANKS = (
    ("agribank", 34.104, 1.717, 1544, 0.368, 0.301, 0.934), ("vpbank", 35.054, 1.535, 4513, 0.349, 0.252, 0.788), ("mbbank", 35.068, 1.284, 3485, 0.337, 0.303, 0.832), ("bidv", 35.168, 1.852, 4330, 0.343, 0.256, 0.744),
    ("ocb", 35.336, 1.849, 1716, 0.344, 0.258, 0.808), ("viettinbank", 35.344, 1.75, 5155, 0.337, 0.244, 0.753), ("shb", 36.034, 0.856, 3898, 0.328, 0.23, 0.788), ("techcombank", 37.178, 0.22, 4303, 0.293, 0.246, 0.833),
    ("vietcombank", 38.72, 2.77, 1550, 0.274, 0.221, 0.81), ("bsc", 41.498, 2.701, 1766, 0.219, 0.184, 0.716),
)
SPEARMAN = {"ewri_old": 0.998, "indeterminate_ratio": 0.983, "implemented_ratio": -0.977, "evidence_ratio": -0.672, "topic_entropy": -0.379, "planning_ratio": -0.180, "avg_evidence_strength": -0.098}
DECOMPOSITION = {"Indeterminate": (33.43, 3.13), "Planning": (0.69, 0.34), "Implemented": (2.23, 0.39)}


@pytest.fixture(scope="module")
def scores(spark):
    return tables.read_table(spark, str(Path(__file__).parent / "golden" / "bank_years.csv")).cache()


def near(got, want, digits):
    return abs(got - want) <= 10.0**-digits + 1e-9  # one unit in the last place


def test_levels(scores):
    """Levels come from unrounded values; none of these stands at an edge."""
    assert scores.count() == 50 and scores.where(risk.level(scores["ewri"]) != scores["risk_level"]).isEmpty()
    got = {(r["formula"], r["risk_level"]): r["n"] for r in analyses.risk_distribution(scores).collect()}
    assert (got["new", "Medium"], got["new", "High"], got["new", "Very High"]) == (42, 7, 1) and got["old", "Very High"] == 50


def test_formulas(scores):
    for r in analyses.compare_formulas(scores).collect():
        for name, want in zip(("mean", "std", "iqr", "range", "cv"), FORMULAS[r["formula"]], strict=True):
            assert near(r[name], want, 1 if name == "cv" else 2), (r["formula"], name)


def test_years(scores):
    names = ("ewri_mean", "ewri_std", "ewri_min", "ewri_max", "ewri_old_mean", "evidence_ratio", "avg_es", "impl_ratio", "topic_entropy")
    got = {r["year"]: r for r in analyses.yearly(scores).collect()}
    assert all(near(got[y][n], w, 3) for y, want in YEARS.items() for n, w in zip(names, want, strict=True)) and len(got) == 5


def test_ranking(scores):
    got = analyses.ranking(scores).orderBy("rank").collect()
    for r, (bank, mean, std, n, impl, ev, entropy) in zip(got, BANKS, strict=True):
        assert (r["bank"], r["total_sentences"]) == (bank, n)
        assert all(near(r[c], w, 3) for c, w in (("ewri_mean", mean), ("ewri_std", std), ("impl_ratio", impl), ("ev_ratio", ev), ("topic_entropy", entropy))), bank


def test_correlations_and_decomposition(scores):
    got = {r["y"]: r["rho"] for r in analyses.spearman_matrix(scores, ("ewri", *SPEARMAN)).where("x = 'ewri'").collect()}
    assert all(near(got[k], w, 3) for k, w in SPEARMAN.items())
    for r in analyses.decomposition(scores).collect():
        mean, std = DECOMPOSITION[r["component"]]
        assert near(r["mean_contribution"], mean, 2) and near(r["std"], std, 2) and near(r["ewri_mean"], 36.35, 2) and near(r["ewri_std"], 2.69, 2)


def test_summary_and_rounding(scores):
    s = risk.summary(scores).first()
    assert (s["n"], s["ewri_min"], s["ewri_max"]) == (50, 31.68, 45.75) and near(s["ewri_mean"], 36.35, 2)
    again = risk.rounded(scores)
    assert tuple(again.columns) == risk.SCORE_COLUMNS and sorted(map(tuple, again.collect())) == sorted(map(tuple, scores.select(*again.columns).collect()))
    assert report.markdown({"levels": [{"a": 1.5}]}).startswith("# Analysis")
