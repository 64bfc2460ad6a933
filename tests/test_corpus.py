import pytest
from pyspark.sql import functions as F

from veridicta.functions.packs import SYNTHETIC_ACTION_RULES, SYNTHETIC_EVIDENCE, SYNTHETIC_KPI_VALUES, SYNTHETIC_TOPIC_RULES
from veridicta.operators import corpus, duplicates, quality
from veridicta.plans.pipeline import ClaimPipeline, run_variants
from veridicta.sources import tables
from veridicta.streaming import scorers

BLOCKS = [
    ("# Tổng quan", "heading_like"), ("BÁO CÁO THƯỜNG NIÊN", "heading_like"), ("B05/TCTD", "meta_heading"), ("a | b\nc | d\ne | f", "table_like"), ("aa   bb\ncc   dd\nee   ff", "table_like"),
    ("- một\n- hai", "bullet_like"), ("• một\n• hai\nba", "bullet_like"), ("Lợi nhuận đạt 5 tỷ đồng.", "kpi_like"), ("Một đoạn văn.", "paragraph"), ("", "paragraph"),
]


def test_block_types(spark):
    df = spark.createDataFrame(BLOCKS, "b string, t string")
    for r in df.select("b", "t", corpus.block_type(F.col("b")).alias("got")).collect():
        assert r["got"] == r["t"], r["b"]


def test_normalize(spark):
    df = spark.createDataFrame([("  a b\t c…\n\n\n\nd é ",), (None,)], "s string")
    assert [r[0] for r in df.select(corpus.normalize(F.col("s"))).collect()] == ["a b c.\n\nd é", None]


@pytest.mark.parametrize("s,noise", [("x" * 14, True), ("Một câu văn mẫu.", False), ("TRANG BÌA CỦA BÁO CÁO", True), ("<!-- image --> and more text", True), ("12.34 56.78 90.12 34.56", True), ("abc 1234567890 12345", True), ("abcde 1234567 7890 1", True), ("abcdef 123456 7890 1", False)])
def test_noise(spark, s, noise):
    assert spark.createDataFrame([(s,)], "s string").select(corpus.is_noise(F.col("s"))).first()[0] is noise


def test_texts_to_sentences(spark, tmp_path):
    folder = tmp_path / "bankx"
    folder.mkdir()
    body = "# Một\n\nCâu thứ nhất của đoạn này. Câu thứ hai của đoạn này! Ngắn.\n\nB05/TCTD\n\nCâu khác của đoạn sau đây.\n\n# Hai\n\nCâu cuối cùng của văn bản.\n\nTrang 12"
    (folder / "rep_2021_2022.txt").write_bytes(body.encode() + b"\xff")
    (folder / "none.txt").write_text("Một câu không có năm nào cả.")
    raw = tables.read_texts(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["bank"], r["year"]) for r in raw.collect()) == [("bankx_0_none", "bankx", 0), ("bankx_2021_rep_2021_2022", "bankx", 2021)]
    s = {r["sent_id"]: r for r in corpus.build_sentences(corpus.build_blocks(raw)).collect()}
    a, b = s["bankx_2021_rep_2021_2022_s1_0"], s["bankx_2021_rep_2021_2022_s1_1"]
    assert (a["ctx_prev"], a["ctx_next"], b["ctx_prev"], b["ctx_next"]) == ("", b["sentence"], a["sentence"], "")
    assert a["section_title"] == "Một" and s["bankx_2021_rep_2021_2022_s3_0"]["section_title"] == "Một" and s["bankx_2021_rep_2021_2022_s5_0"]["section_title"] == "Hai"
    assert s["bankx_0_none_s0_0"]["section_title"] == "UNKNOWN" and len(s) == 5
    with pytest.raises(FileNotFoundError):
        tables.read_texts(spark, str(tmp_path / "bankx" / ".."  / "empty_folder_") if (tmp_path / "empty_folder_").mkdir() is None else "")
    with pytest.raises(ValueError):
        tables.read_texts(spark, str(tmp_path / "x.pdf"))


def test_duplicates(spark):
    texts = ["the same sentence here"] + [f"{i} other words {i * 7919} go here {i}" for i in range(50)] + ["the same sentence here", "the same sentence here!", "ab", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    greedy = {r["i"]: r["_is_duplicate"] for r in quality.greedy_duplicates(df, "i").collect()}
    pairs = {r["i"]: r["_is_duplicate"] for r in quality.pairwise_duplicates(df, "i").collect()}
    assert not greedy[51] and greedy[52] and not greedy[54]  # 51 rows back is out of sight
    assert pairs[51] and pairs[52] and not pairs[54] and not pairs[0]


def test_length_and_ocr(spark):
    df = spark.createDataFrame([("a" * 19,), ("ab " * 7,), ("x" * 501,), ("ok text �",), (None,)], "sentence string")
    got = quality.check_ocr(quality.check_length(df)).collect()
    assert [r["_length_ok"] for r in got] == [False, True, False, False, False]
    assert got[3]["_ocr_artifact_ratio"] == pytest.approx(1 / 9) and got[4]["_ocr_clean"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', ["x", "y"])], "i int, s string, l array<string>")
    tables.write_csv(df, str(tmp_path / "t.csv"))
    r = tables.read_table(spark, str(tmp_path / "t.csv")).first()
    assert (r["i"], r["s"], r["l"]) == (1, 'a "q"\nb', "x|y")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")
    assert tables.runtime_settings({"common": {"a": {"b": 1, "c": 2}}, "tasks": {"t": {"a": {"c": 3}}}, "profiles": {"p": {"d": 4}}}, "t", "p") == {"a": {"b": 1, "c": 3}, "d": 4}
    (tmp_path / "output" / "m" / "final").mkdir(parents=True)
    assert tables.model_folder(str(tmp_path / "outputs" / "m")) == str(tmp_path / "output" / "m")


def test_labeling_resumes(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", f"a sentence of enough length {i}") for i in range(7)], "sent_id string, sentence string")
    label = lambda d: d.select("sent_id").withColumn("reply", F.lit("{}"))
    path = str(tmp_path / "labels")
    assert scorers.label_batches(df.where("sent_id < 's3'"), label, path, 2) == 2
    assert scorers.label_batches(df, label, path, 3) == 2
    assert spark.read.parquet(path).select("sent_id").distinct().count() == spark.read.parquet(path).count() == 7


def test_pipeline(spark, tmp_path):
    folder = tmp_path / "in" / "bank"
    folder.mkdir(parents=True)
    for y in (2020, 2021):
        text = ". ".join(f"The bank reported {i} of the results in {y} and to the end" for i in range(15)) + "."
        (folder / f"r{y}.txt").write_text(text + "\n\n" + text.replace("reported", "planned"))
    p = ClaimPipeline(spark, str(tmp_path / "out"), SYNTHETIC_TOPIC_RULES, SYNTHETIC_ACTION_RULES, SYNTHETIC_EVIDENCE, SYNTHETIC_KPI_VALUES)
    out = p.run(str(tmp_path / "in"))
    assert out["scores"].count() == 2
    assert (tmp_path / "out" / "reports" / "report.json").exists() and (tmp_path / "out" / "analysis" / "analysis_report.md").exists()
    again = p.run(linked=spark.read.parquet(str(tmp_path / "out" / "evidence.parquet")))
    assert again["scores"].count() == 2
    assert run_variants(spark.read.parquet(str(tmp_path / "out" / "evidence.parquet")).select("bank", "year", "sent_pos", "sentence", "embedding", "evidence_types", "has_evidence", "action_label")).count() == 3


def test_positions_of_any_ids(spark):
    rows = [("b", 2), ("b", 1), ("a", 1), (None, 3), ("a", 2), (None, 1), ("c", 1)]
    df = spark.createDataFrame(rows, "doc string, k int")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    got = {(r["doc"], r["k"]): r["at"] for r in corpus.with_position(df, "doc", "k", name="at").collect()}
    assert got == {r: i for i, r in enumerate(want)}
    grouped = df.withColumn("bank", F.when(F.col("doc") == "b", "x").otherwise(F.lit(None)))
    got = {(r["doc"], r["k"]): r["at"] for r in corpus.with_position(grouped, "doc", "k", name="at", by=("bank",)).collect()}
    assert [got["b", 1], got["b", 2]] == [0, 1] and [got[r] for r in want if r[0] != "b"] == [0, 1, 2, 3, 4]
    assert corpus.with_position(df.where("false"), "doc", "k").count() == 0


def test_pipeline_positions_follow_the_text(spark, tmp_path):
    """More than ten blocks and two documents of one bank and year: places are those in the texts, not of ids as texts."""
    folder = tmp_path / "in" / "bank"
    folder.mkdir(parents=True)
    for name in ("a", "b"):
        blocks = [f"The bank {name} reported {i} results of the year in full. The second one of {i} is to follow." for i in range(14)]
        (folder / f"r2020{name}.txt").write_text("\n\n".join(blocks))
    p = ClaimPipeline(spark, None, SYNTHETIC_TOPIC_RULES, SYNTHETIC_ACTION_RULES, SYNTHETIC_EVIDENCE, SYNTHETIC_KPI_VALUES)
    s = p.build_corpus(str(tmp_path / "in"))
    want = [f"bank_2020_r2020{n}_s{i}_{k}" for n in "ab" for i in range(14) for k in range(2)]
    assert [r["sent_id"] for r in corpus.text_position(s).orderBy("sent_pos").collect()] == want
    bare = s.select("bank", "year", "sent_id", "sentence")
    assert [r["sent_id"] for r in corpus.text_position(bare).orderBy("sent_pos").collect()] == want
    linked = p.find_evidence(p.classify(s))
    assert {r["sent_id"]: r["sent_pos"] for r in linked.select("sent_id", "sent_pos").collect()} == {x: i for i, x in enumerate(want)}


def test_nli_scorer(spark):
    pairs = spark.createDataFrame([("a", "b", 1), (None, "claim", 2)], "evidence_text string, claim_text string, k int")
    load = lambda: lambda both: [(0.0, 1.0, 3.0) if b == "b" else (2.0, 1.0, 0.0) for _, b in both]
    got = {r["k"]: r for r in scorers.nli_scorer(load)(pairs).collect()}
    assert got[1]["nli_label"] == "entailment" and got[2]["nli_label"] == "contradiction"
    assert got[1]["entailment"] + got[1]["neutral"] + got[1]["contradiction"] == pytest.approx(1)
    assert scorers.nli_pair(spark, "a", "b", scorers.nli_scorer(load))["nli_label"] == "entailment"


def test_exact_duplicates_on_a_sample(spark):
    df = spark.createDataFrame([(i, f"a sentence that is the same {i // 60}") for i in range(120)], "i int, sentence string")
    all_ = quality.run_checks(df, "i", exact=True)
    some = quality.run_checks(df, "i", exact=True, most=30)
    assert all_.count() == some.count() == 120
    assert all_.where("_is_duplicate").count() > some.where("_is_duplicate").count() > 0


def test_crowded_grams_are_compared_in_blocks(spark, monkeypatch):
    """Near variants of one sentence that many rows share, with and without pairs as rows."""
    import random

    rng = random.Random(2)
    base = "the bank will report on all of its results for the year in full and in time"
    texts = [base.replace("all", rng.choice(["all", "some", "most"]) + str(rng.randrange(30))) + rng.choice(["", "!", " x" * rng.randrange(9)]) for _ in range(80)] + [f"other {i * 77777} words {i}" for i in range(40)]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = [any(len(g & h) / len(g | h) >= 0.9 for h in grams[:i]) for i, g in enumerate(grams)]
    assert 10 < sum(want) < 80
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    for crowd, block in ((100, 1000), (3, 7)):
        monkeypatch.setattr(duplicates, "CROWD", crowd)
        monkeypatch.setattr(duplicates, "BLOCK", block)
        got = {r["i"]: r["_is_duplicate"] for r in quality.pairwise_duplicates(df, "i").collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_exploded_sentences_hold_no_copy_of_their_text(spark):
    """Each row has its neighbours; none has the array that it comes from, which would be quadratic in long texts."""
    import re

    from veridicta.queries import sentences

    blocks = spark.createDataFrame([("d", "a", 2020, "s", "b", "paragraph", "One sentence is here. Another one is here. The third one is here.", 0, "T")], "doc_id string, bank string, year int, section_id string, block_id string, block_type string, block_text string, order_in_doc int, section_title string")
    built = corpus.build_sentences(blocks)
    assert [(r["sent_idx_in_block"], r["ctx_prev"], r["sentence"], r["ctx_next"]) for r in built.orderBy("sent_idx_in_block").collect()] == [
        (0, "", "One sentence is here.", "Another one is here."), (1, "One sentence is here.", "Another one is here.", "The third one is here."), (2, "Another one is here.", "The third one is here.", ""),
    ]
    for d in (built, sentences(spark, "/root/testdata/sf0.001")):
        kept = re.findall(r"(?s)Generate posexplode\(.*?\), \[([^\]]*)\], false, \[", d._jdf.queryExecution().executedPlan().toString())
        assert kept and not any(re.search(r"__all|__p#|text#|block_text#", k) for k in kept)


def test_strip_is_unicode_white_space(spark):
    from pyspark.sql import functions as F

    from veridicta.functions.expressions import strip

    d = spark.createDataFrame([(chr(c) + "a" + chr(c) + "b\n" + chr(c),) for c in [*range(0x3100), 0xFEFF]] + [("",), (" ",), (None,)], "t string")
    assert d.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_window_candidates_are_all_pairs_in_the_window(spark):
    """Gaps, repeated and negative positions, and two documents; sentences are exchanged about twice, not for each offset."""
    from veridicta.operators import linking

    rows = [(b, 2020, p) for b, ps in (("a", [-21, -20, -3, 0, 1, 1, 4, 19, 20, 25, 26, 2**40, 2**40 + 5]), ("b", [0, 5, 6]), (None, [1, 2])) for p in ps]
    d = spark.createDataFrame(rows, "bank string, year int, sent_pos long")
    got = sorted(tuple(r) for r in linking.window_candidates(d).collect())
    expected = sorted((a, 2020, p, q, 1.0 - abs(p - q) / 6.0 * 0.3) for a, _, p in rows for b, _, q in rows if a == b and a and 0 < abs(p - q) <= 5)
    assert got == expected
    right = spark.createDataFrame([("a", 2020, p) for p in range(2000)], d.schema)
    plan = linking.window_candidates(right)._jdf.queryExecution().optimizedPlan().toString()
    assert "array(-5" not in plan and "[-5,-4" not in plan


def test_positions_exchange_rows_once(spark):
    """The window and the join that follows it share one key; equal ids in several banks, and null ones, keep their places."""
    rows = [(b, 2020, d, f"t{k}") for b in ("a", "b", None) for d in (None, 1, 2) for k in range(3)]
    d = spark.createDataFrame(rows, "bank string, year int, doc int, t string")
    got = corpus.with_position(d, "doc", "t", by=("bank", "year"))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len([x for x in plan if x.lstrip().startswith(":") and "hashpartitioning" in x]) == 1  # the join's left side
    assert sorted((str(r["bank"]), r["sent_pos"], r["doc"] or 0, r["t"]) for r in got.collect()) == sorted((str(b), 3 * (x or 0) + int(t[1]), x or 0, t) for b, _, x, t in rows)


def test_csv_files_have_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 10)
    df, path = spark.range(25).selectExpr("id", "concat('a\n', id) AS t").coalesce(1), str(tmp_path / "t.csv")
    tables.write_csv(df, path)
    assert len(list((tmp_path / "t.csv").glob("part-*.csv"))) == 3
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == sorted(map(tuple, df.collect()))


def test_a_batch_is_laid_out_in_one_file(spark, tmp_path, monkeypatch):
    """Not in a file for each task, of which batches times tasks would be written."""
    monkeypatch.setattr(scorers, "SMALL", 10)
    df, path = spark.createDataFrame([(f"s{i}", f"a sentence of enough length {i}") for i in range(200)], "sent_id string, sentence string").repartition(8), str(tmp_path / "out")
    assert scorers.label_batches(df, lambda d: d.select("sent_id"), path, 50) == 4
    assert [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "out_todo").glob("__batch=*"))] == [1] * 4
    assert spark.read.parquet(path).distinct().count() == 200
