"""Sinks on any file system, jobs of the command line, and columns of the input under names that operators use too."""

import json

import pytest
from pyspark.sql import functions as F

from veridicta.operators import corpus, evidence, neuro, rules
from veridicta.plans import pipeline
from veridicta.sources import tables


def test_text_files_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b/report.json"
    for said in ("ngân hàng\n", "", "x" * 100_000):
        tables.write_text(said, path)
        assert tables.read_text(path) == said
    assert [p.name for p in (tmp_path / "a" / "b").iterdir() if not p.name.endswith(".crc")] == ["report.json"]
    tables.write_text("again", str(tmp_path / "plain.txt"))
    assert (tmp_path / "plain.txt").read_text() == "again"


def test_analyses_and_csv_go_to_a_uri(spark, tmp_path):
    df = spark.range(40).select(F.col("id"), F.concat(F.lit('a "q"\n'), F.col("id").cast("string")).alias("s")).repartition(4)
    folder = f"file://{tmp_path}/out"
    tables.save_analyses({"bank_ranking": df}, folder)
    assert len(json.loads(tables.read_text(f"{folder}/analysis_results.json"))["bank_ranking"]) == 40
    assert tables.read_table(spark, f"{folder}/bank_ranking.csv").count() == 40
    tables.write_csv(df, f"{folder}/many.csv")
    assert len(list((tmp_path / "out" / "many.csv").glob("part-*"))) == 4 and len(list((tmp_path / "out" / "bank_ranking.csv").glob("part-*"))) == 1
    assert {tuple(r) for r in tables.read_table(spark, f"{folder}/many.csv").collect()} == {tuple(r) for r in df.collect()}


def test_key_goes_in_a_header(monkeypatch):
    import urllib.request

    import pandas as pd

    seen = []

    def answer(request, timeout):
        seen.append(request)
        raise OSError("no network")

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    got = next(iter(tables.http_labeler("http://x/y", "secret")(iter([pd.DataFrame({"sent_id": ["a"], "prompt": ["p"]})]))))
    assert got["reply"].tolist() == ["error: no network"]
    assert seen[0].full_url == "http://x/y" and "secret" in seen[0].headers.values()


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"d{i // 10}_s0_{i % 10}", "bank", 2020 + i // 20, f"The bank reported the loan number {i // 2} of the results to the end", ("E", "G")[i % 2], "Implemented", "Implemented", bool(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "sent_id string, bank string, year int, sentence string, topic_label string, action_label string, action string, has_evidence boolean")
    df.write.parquet(str(tmp_path / "in.parquet"))
    return str(tmp_path / "in.parquet")


@pytest.mark.parametrize("exact", [[], ["--exact"]])
def test_quality_job(spark, tmp_path, table, exact):
    pipeline.main(["--job", "quality", "--input", table, "--output", str(tmp_path / "out"), "--label", "topic_label", *exact])
    checked = spark.read.parquet(str(tmp_path / "out" / "checked.parquet"))
    assert checked.count() == 40 and checked.where("_is_duplicate").count() >= 20
    assert tables.read_table(spark, str(tmp_path / "out" / "quality.csv")).first()["duplicates"] == checked.where("_is_duplicate").count()
    assert tables.read_table(spark, str(tmp_path / "out" / "balance.csv")).count() == 2


@pytest.mark.parametrize("encoder", ["fitted", "hashed"])
def test_variants_job(spark, tmp_path, table, encoder):
    pipeline.main(["--job", "variants", "--input", table, "--output", str(tmp_path / "out"), "--encoder", encoder])
    out = spark.read.parquet(str(tmp_path / "out" / "evidence_variants.parquet"))
    assert {r["evidence_variant"]: r["count"] for r in out.groupBy("evidence_variant").count().collect()} == {"nli": 40, "window": 40, "no_nli": 40}
    assert tables.read_table(spark, str(tmp_path / "out" / "evidence_variant_summary.csv")).count() == 3


def test_columns_of_the_input_stay(spark):
    names = ["__doc", "__k", "__base", "__mask", "__l", "__q0", "__text", "__block", "__place", "__t"]
    df = spark.createDataFrame([("d1_s0_0", "b", 2020, "The energy audit by 2030", *names), ("d1_s0_1", "b", 2020, "Other", *names)], ", ".join(["sent_id string", "bank string", "year int", "sentence string", *(f"{n} string" for n in names)]))
    kb = neuro.knowledge_base("topic")
    for out in (corpus.text_position(df), corpus.with_position(df, "sent_id", "sentence"), evidence.detect(df, "sentence"), neuro.truths(df, kb), rules.match_topics(df, context=None)):
        assert [tuple(r[n] for n in names) for r in out.collect()] == [tuple(names)] * 2


def test_texts_of_some_banks_and_years(spark, tmp_path):
    """Other folders and other years' files are not among the files that are opened."""
    for bank in ("x", "y", "deep/er/x"):
        for name in ("r2020", "r2021_2020", "none"):
            p = tmp_path / "in" / bank / f"{name}.txt"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(f"{bank} {name}")
    top = str(tmp_path / "in")
    opened = lambda d: {f.split("/in/")[1] for f in d.inputFiles()}
    all_ = tables.read_texts(spark, top)
    assert all_.count() == 9
    x = tables.read_texts(spark, top, banks=["x"])
    assert opened(x) == {f"{b}/{n}.txt" for b in ("x", "deep/er/x") for n in ("r2020", "r2021_2020", "none")} and {r["bank"] for r in x.collect()} == {"x"}
    y = tables.read_texts(spark, top, banks=["y"], years=[2021])
    assert opened(y) == {"y/r2021_2020.txt"} and [(r["doc_id"], r["content"]) for r in y.collect()] == [("y_2021_r2021_2020", "y r2021_2020")]
    assert {r["doc_id"] for r in tables.read_texts(spark, top, years=[2020]).collect()} == {"x_2020_r2020", "y_2020_r2020"}
    assert tables.read_texts(spark, top, years=[0]).count() == 3 and tables.read_texts(spark, f"{top}/y", banks=["y"]).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_texts(spark, top, banks=["z"])
