import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridicta.functions.packs import Rule
from veridicta.operators import neuro
from veridicta.plans import labeling, training


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(3)
    z, y, w = rng.normal(size=(6, 3)), rng.integers(0, 3, 6), rng.uniform(0.5, 2, 6)
    truth = rng.choice([0.0, 0.5, 1.0], (6, 3))
    rules = [("implication", 0), ("implication", 2), ("negation", 1)]
    for kind, (_, _, grad) in training.losses(training.softmax(z), y, w, truth, rules).items():
        for i, j in ((0, 0), (2, 1), (5, 2)):
            step = np.zeros_like(z)
            step[i, j] = 1e-5
            up, down = (training.losses(training.softmax(x), y, w, truth, rules)[kind][0] for x in (z + step, z - step))
            assert (up - down) / 2e-5 == pytest.approx(grad[i, j], abs=1e-4), kind


def test_losses_are_the_operators(spark):
    """The same sums as the Column form of the semantic loss."""
    kb = neuro.knowledge_base("action", rules=(Rule("Implemented", "a", "", "", ("aa",)), Rule("Planning", "b", "", "", ("bb",))), negations=(Rule("Implemented", "n", "", "n", ("cc",)),))
    rows = [("aa bb", [0.2, 0.3, 0.5]), ("cc", [0.6, 0.3, 0.1]), ("x", [0.1, 0.1, 0.8])]
    want = neuro.semantic_loss(neuro.truths(spark.createDataFrame(rows, "sentence string, probs array<double>"), kb), kb).first()
    truth = np.array([[float(p in t) / 2 for p in ("aa", "bb", "cc")] for t, _ in rows])
    got = training.losses(np.array([p for _, p in rows]), np.zeros(3, int), np.ones(3), truth, [(c.kind, kb.labels.index(c.target)) for c in kb.rules])
    for kind in ("exactly_one", "implication", "negation"):
        assert got[kind][0] / max(1, got[kind][1]) == pytest.approx(want[kind], abs=1e-6)


def test_training_saving_and_scores(spark, tmp_path):
    rng = random.Random(1)
    names = ("Implemented", "Planning", "Indeterminate")
    own = (["did", "done", "built"], ["will", "plan", "aim"], ["maybe", "might", "some"])
    rows = [(i, " ".join(rng.choices(own[i % 3], k=3) + rng.choices(["the", "a", "bank"], k=5)), names[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, text string, label string")
    kb = neuro.knowledge_base("action", rules=(Rule("Planning", "p", "", "", ("will",)),), negations=())
    model, scores = training.train_and_evaluate(df, "label", names, "k", kb, folder=str(tmp_path / "m"), steps=12)
    got = {(r["split"], r["run"]): r["macro_f1"] for r in scores.collect()}
    assert len(got) == 6 and got["test", "model"] > 0.9 and got["val", "model_and_rules"] > 0.8
    again = training.LinearModel.load(spark, str(tmp_path / "m"))
    assert again.labels == names and np.array_equal(again.weights, model.weights)
    assert training.predict(again, df).where(F.col("predicted") == F.col("label")).count() > 220


def test_labeling_job(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", f"a sentence of enough length {i}", "", "", "title") for i in range(5)], "sent_id string, sentence string, ctx_prev string, ctx_next string, section_title string")

    def labeler(parts):
        for p in parts:
            yield p[["sent_id"]].assign(reply=['{"topic": "E", "confidence": 0.9, "reason": "r"}' if "3" not in t else "nothing" for t in p["prompt"]])

    path = str(tmp_path / "out")
    assert labeling.label_table(df, path, labeler, batch=2) == 3 and labeling.label_table(df, path, labeler) == 0
    got = {r["sent_id"]: r["llm_label"] for r in spark.read.parquet(path).collect()}
    assert got == {f"s{i}": "Non_ESG" if i == 3 else "E" for i in range(5)}


def test_rows_hold_only_what_is_not_zero():
    """Products against a whole matrix; no rows times features are made."""
    import numpy as np
    import pyarrow as pa

    from veridicta.plans.training import FEATURES, Rows

    rng = np.random.default_rng(0)
    rows = [[], [3, 3, 3], [FEATURES - 1], *(rng.integers(0, FEATURES, n).tolist() for n in range(30))]
    whole = np.zeros((len(rows), FEATURES + 1))
    for i, r in enumerate(rows):
        np.add.at(whole[i], r, 1)
        whole[i] /= max(1, np.sqrt((whole[i] ** 2).sum()))
    whole[:, -1] = 1
    x, right, left = Rows(pa.array(rows, pa.list_(pa.int32()))), rng.normal(size=(FEATURES + 1, 3)), rng.normal(size=(len(rows), 3))
    assert np.allclose(x.times(right), whole @ right) and np.allclose(x.transposed_times(left), whole.T @ left)
    assert len(x.value) <= sum(map(len, rows))


def test_split_orders_no_label_in_one_task(spark):
    """The cuts of one order of each label, null too, with windows over parts of a label only."""
    from hashlib import md5

    from veridicta.operators import labels

    rows = [(k, ["a", "b", None][k % 7 % 3]) for k in range(2000)] + [(None, "a")]
    d = labels.stratified_split(spark.createDataFrame(rows, "k int, y string"), "y", "k")
    assert d.columns == ["k", "y", "split"]
    expected = set()
    for y in ("a", "b", None):
        mine = sorted((k for k, z in rows if z == y), key=lambda k: (md5(("42" if k is None else f"42:{k}").encode()).hexdigest(), k is not None, k))
        expected |= {(k, y, "train" if i <= round(len(mine) * 0.8) else "val" if i <= round(len(mine) * 0.9) else "test") for i, k in enumerate(mine, 1)}
    assert {tuple(r) for r in d.collect()} == expected
    windows = [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number(" in x and "Window" in x]
    assert windows and all("__part" in x for x in windows)
