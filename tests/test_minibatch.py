"""Mini-batch training against a loop in numpy, early stopping, going on behind a stop, and the job of the command line."""

import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridicta.functions.packs import Rule
from veridicta.operators import neuro
from veridicta.plans import experiment, minibatch, training
from veridicta.plans.minibatch import Settings, best_epoch, fit
from veridicta.sources import tables

NAMES = ("Implemented", "Planning", "Indeterminate")
OWN = (["did", "done", "built"], ["will", "plan", "aim"], ["maybe", "might", "some"])
KB = neuro.knowledge_base("action", rules=(Rule("Planning", "p", "", "", ("will",)),), negations=(Rule("Implemented", "n", "", "n", ("maybe",)),))
HOW = Settings(epochs=3, batch=16, rate=0.1, parts=3)


def rows(spark, n=150):
    rng = random.Random(7)
    made = [(f"k{i}", " ".join(rng.choices(OWN[i % 3], k=2) + rng.choices(["the", "a", "bank"], k=4)), NAMES[i % 3], i % 3, 1.0 + i % 2) for i in range(n)]
    made += [("k0", None, NAMES[0], 0, 1.0), (None, "", NAMES[1], 1, 1.0), (None, "", NAMES[1], 1, 1.0), ("x" * 9, "did " * 20_000, NAMES[0], 0, 1.0), ("no", "did", None, None, 1.0)]
    return spark.createDataFrame(made, "k string, text string, label string, label_id int, weight double")


def in_numpy(d, epochs, how, steps, kinds):
    """The same steps by a loop over rows, with the losses of one row at a time."""
    w = np.zeros((training.FEATURES + 1, 3))
    m, v, t, total, out = np.zeros_like(w), np.zeros_like(w), 0, steps * epochs, []
    for epoch in range(epochs):
        by = {}
        for r in minibatch.dealt(d, epoch, steps, how.seed).collect():
            by.setdefault(r["step"], []).append(r)
        seen = 0.0
        for step in range(steps):
            t += 1
            if step not in by:
                continue
            sums, terms, grads = {}, {}, {}
            for r in by[step]:
                x = np.zeros(len(w))
                for f in r["features"]:
                    x[f] += 1
                x /= max(1, np.sqrt((x * x).sum()))
                x[-1] = 1
                z = x @ w
                p = np.exp(z - z.max())[None] / np.exp(z - z.max()).sum()
                for kind, (a, n, g) in training.losses(p, np.array([r["y"]]), np.array([r["w"]]), np.array([r["truth"]]), kinds).items():
                    sums[kind], terms[kind] = sums.get(kind, 0) + a, terms.get(kind, 0) + n
                    grads[kind] = grads.get(kind, 0) + np.outer(x, g[0])
            share = {k: s * (1 if k == "cross_entropy" else how.rules_weight) / max(1, terms[k]) for k, s in training.SHARES.items()}
            seen += sum(share[k] * sums[k] for k in share)
            g = sum(share[k] * grads[k] for k in share)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            warm = int(how.warmup * total)
            at = t / warm if t <= warm else (total - t + 1) / (total - warm)
            w = w - how.rate * at * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + how.decay * w)
        out.append(seen / steps)
    return w, out


def test_steps_are_those_of_a_loop_for_any_number_of_parts(spark):
    df = rows(spark)
    d = minibatch.prepared(df, "k", KB, "text", "label_id", "weight")
    kinds = [(c.kind, NAMES.index(c.target)) for c in KB.rules]
    n = d.count()
    assert n == 154  # the row without a label is gone
    want, losses = in_numpy(d, HOW.epochs, HOW, -(-n // HOW.batch), kinds)
    none = df.limit(0)  # the last epoch counts
    for parts in (1, 3):
        model, history = fit(df, none, NAMES, "k", KB, weight="weight", how=replace(HOW, parts=parts))
        assert np.allclose(model.weights, want, atol=1e-9) and [h["loss"] for h in history] == pytest.approx(losses)
        assert not any(h["best"] for h in history)


def test_small_batches_send_the_driver_a_state_a_run(spark, monkeypatch):
    """As many steps as there are rows, in runs of 64: three states come back, not 154 gradients."""
    df, sent = rows(spark), []
    d = minibatch.prepared(df, "k", KB, "text", "label_id", "weight")
    kinds = [(c.kind, NAMES.index(c.target)) for c in KB.rules]
    how, collect = replace(HOW, epochs=1, batch=1), type(d).collect

    def counted(self):
        out = collect(self)
        sent.append(sum(len(x) for r in out for x in r if isinstance(x, bytes | bytearray)))
        return out

    want, losses = in_numpy(d, 1, how, 154, kinds)
    monkeypatch.setattr(minibatch, "RUN", 64)
    monkeypatch.setattr(type(d), "collect", counted)
    model, history = fit(df, df.limit(0), NAMES, "k", KB, weight="weight", how=how)
    assert np.allclose(model.weights, want, atol=1e-9) and history[0]["loss"] == pytest.approx(losses[0])
    assert sum(sent) == 3 * 3 * model.weights.nbytes


def test_large_batches_go_by_parts(spark, monkeypatch):
    df = rows(spark)
    d = minibatch.prepared(df, "k", KB, "text", "label_id", "weight")
    kinds = [(c.kind, NAMES.index(c.target)) for c in KB.rules]
    monkeypatch.setattr(minibatch, "RUN", 1)
    want, losses = in_numpy(d, HOW.epochs, HOW, -(-154 // HOW.batch), kinds)
    for parts in (1, 3):
        model, history = fit(df, df.limit(0), NAMES, "k", KB, weight="weight", how=replace(HOW, parts=parts))
        assert np.allclose(model.weights, want, atol=1e-9) and [h["loss"] for h in history] == pytest.approx(losses)


def test_a_stopped_run_goes_on_alike(spark, tmp_path, monkeypatch):
    df, how = rows(spark), replace(HOW, patience=None)
    whole, history = fit(df, df, NAMES, "k", KB, how=how)
    folder, one, ran = str(tmp_path / "states"), minibatch._epoch, []

    def lost(d, state, epoch, *rest):
        if epoch == 2:
            raise RuntimeError("lost")
        return one(d, state, epoch, *rest)

    monkeypatch.setattr(minibatch, "_epoch", lost)
    with pytest.raises(RuntimeError):
        fit(df, df, NAMES, "k", KB, how=how, folder=folder)
    monkeypatch.setattr(minibatch, "_epoch", lambda d, s, e, *r: ran.append(e) or one(d, s, e, *r))
    again, second = fit(df, df, NAMES, "k", KB, how=how, folder=folder)
    assert ran == [2] and np.array_equal(again.weights, whole.weights) and second == history
    third, _ = fit(df, df, NAMES, "k", KB, how=how, folder=folder)
    assert ran == [2] and np.array_equal(third.weights, whole.weights)
    with pytest.raises(ValueError, match="other settings"):
        fit(df, df, NAMES, "k", KB, how=replace(how, rate=0.2), folder=folder)


def test_when_to_stop():
    assert best_epoch([], 2) == (None, False)
    assert best_epoch([0.5, 0.6, 0.6], 2) == (1, False)
    assert best_epoch([0.5, 0.6, 0.6, 0.55], 2) == (1, True)
    assert best_epoch([0.5, 0.6, 0.55, 0.7, 0.1], 2) == (3, False)
    assert best_epoch([0.5, 0.505, 0.51], 2, 0.02) == (2, True)  # better ones, but by too little
    assert best_epoch([0.5, 0.1, 0.1, 0.1], None) == (0, False)
    assert best_epoch([None, 0.2, None], 1) == (1, False)


def test_stops_early_and_takes_the_best_epoch(spark, monkeypatch):
    df, made = rows(spark), iter([0.4, 0.8, 0.7, 0.6, 0.5])
    kept, one = [], minibatch._epoch

    def epoch(*a):
        out = one(*a)
        kept.append(out[0].weights)
        return out

    monkeypatch.setattr(minibatch, "_epoch", epoch)
    monkeypatch.setattr(minibatch.L, "f1_summary", lambda d, *_: d.sparkSession.createDataFrame([(next(made), 0.0)], "macro_f1 double, micro_f1 double"))
    model, history = fit(df, df, NAMES, "k", how=replace(HOW, epochs=5, patience=2))
    assert [h["macro_f1"] for h in history] == [0.4, 0.8, 0.7, 0.6] and [h["best"] for h in history] == [False, True, False, False]
    assert np.array_equal(model.weights, kept[1])


def test_nothing_to_learn_from(spark):
    none = rows(spark).limit(0)
    model, history = fit(none, none, NAMES, "k", KB, how=replace(HOW, epochs=1))
    assert not model.weights.any() and history[0]["loss"] == 0 and history[0]["macro_f1"] is None


def test_job_compares_runs(spark, tmp_path, capsys):
    config = tmp_path / "c.yml"
    config.write_text("common:\n  training: {epochs: 4, train_batch_size: 8, gradient_accumulation_steps: 2, weight_decay: 0.0}\n  early_stopping: {patience: 3}\n  neuro_symbolic: {constraint_lambda: 0.3}\ntasks:\n  action:\n    paths: {output_dir: out}\n")
    experiment.main(["--task", "action", "--config", str(config), "--alpha-grid", "0.5,0.9", "--dry-run", "--seed", "3"])
    said = json.loads(capsys.readouterr().out)
    assert said["training"] == vars(Settings(epochs=4, batch=16, decay=0.0, patience=3, rules_weight=0.3, seed=3)) and said["alpha_grid"] == [0.5, 0.9]
    path, out = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    rows(spark, 240).select("k", "text", F.col("label").alias("action_label"), F.lit("theirs").alias("__weight")).write.parquet(path)
    experiment.main(["--input", path, "--task", "action", "--config", str(config), "--key", "k", "--text", "text", "--alpha-grid", "0.5,0.9", "--rate", "0.1", "--run-experiment", "--output", out])
    got = json.loads(tables.read_text(f"{out}/comparison_summary.json"))
    assert got["baseline"]["test_neural"]["macro_f1"] > 0.9 and [r["alpha"] for r in got["neuro_symbolic"]["val_constrained_search"]] == [0.5, 0.9]
    assert got["neuro_symbolic"]["best_alpha"] in (0.5, 0.9) and "val_constrained_search" not in got["baseline"]
    again = training.LinearModel.load(spark, f"{out}/neuro_symbolic/final")
    assert again.labels == NAMES and again.weights.any()
