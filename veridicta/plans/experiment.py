"""A training run with its scores and the search for alpha, and the comparison of a run without rules and one with them.

Settings are those of a file (common, task, profile; ``--config``), with the command line's on top.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.functions.expressions import free
from veridicta.operators import labels as L
from veridicta.operators import neuro
from veridicta.plans.minibatch import Settings, fit
from veridicta.plans.training import LinearModel, predict
from veridicta.sources import tables

GRID = (0.3, 0.5, 0.7, 0.9)


def settings_of(config: dict, **over) -> Settings:
    """Of a task's settings; ``over`` wins where it isn't None."""
    t, e, n = config.get("training", {}), config.get("early_stopping", {}), config.get("neuro_symbolic", {})
    plain = Settings()
    got = {
        "epochs": t.get("epochs"), "decay": t.get("weight_decay"), "warmup": t.get("warmup_ratio"), "threshold": e.get("threshold"), "seed": config.get("seed"), "rules_weight": n.get("constraint_lambda"),
        "batch": t["train_batch_size"] * t.get("gradient_accumulation_steps", 1) if "train_batch_size" in t else None,
    }
    got |= {k: v for k, v in over.items() if v is not None}
    got = {k: v for k, v in got.items() if v is not None}
    got["patience"] = e.get("patience", plain.patience) if e.get("enabled", True) else None
    return Settings(**got)


def _scores(df: DataFrame, label: str, predicted: str) -> dict:
    s = L.f1_summary(df, label, predicted).first()
    per = L.f1_report(df, label, predicted).orderBy("label").collect()  # a row a label
    return {"macro_f1": s["macro_f1"], "micro_f1": s["micro_f1"], "per_label": {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in per}}


def run(df: DataFrame, label: str, kb: neuro.KnowledgeBase, key: str, text: str = "sentence", how: Settings = Settings(), rules: bool = True, grid: tuple[float, ...] = GRID, weights: str | None = "sqrt_inverse", folder: str | None = None, states: str | None = None) -> tuple[LinearModel, dict]:
    """Splits unless there is a split, fits on train with the stop on val, and scores val and test; with ``rules`` in the
    loss, and fused at the alpha that is best on val.  ``folder`` keeps the model, and the scores in
    metrics_summary.json; ``states`` the states of the epochs."""
    d = L.encode(df, label, kb.labels)
    if "split" not in df.columns:
        d = L.stratified_split(d, label, key)
    (w,) = free(d.columns, "weight")
    train, val, test = (d.where(F.col("split") == s) for s in ("train", "val", "test"))
    if weights:
        by = L.class_weights(train, label, kb.labels, weights).select(F.col("label").alias(label), F.col("weight").alias(w))
        train = train.join(F.broadcast(by), label)  # a row a label
    model, history = fit(train, val, kb.labels, key, kb if rules else None, text, weight=w if weights else None, how=how, folder=states)
    out = {"mode": "neuro" if rules else "baseline", "label": label, "epochs": history, "best_epoch": next((h["epoch"] for h in history if h["best"]), None)}
    seen = {name: predict(model, part, text) for name, part in (("val", val), ("test", test))}
    for name, part in seen.items():
        out[f"{name}_neural"] = _scores(part, label, "predicted")
    if rules:
        found = [r.asDict() for r in neuro.alpha_search(neuro.truths(seen["val"], kb, text), kb, label, grid=grid).orderBy("alpha").collect()]  # a row an alpha
        best = next((r["alpha"] for r in found if r["best"]), None)
        out |= {"val_constrained_search": found, "best_alpha": best}
        if best is not None:
            out["test_constrained"] = {"alpha": best, **_scores(neuro.fuse(neuro.truths(seen["test"], kb, text), kb, "logits", best), label, "label")}
    if folder:
        model.save(df.sparkSession, f"{folder}/final")
        tables.write_text(json.dumps(out, ensure_ascii=False, indent=2), f"{folder}/metrics_summary.json")
    return model, out


def compare(df: DataFrame, label: str, kb: neuro.KnowledgeBase, key: str, folder: str | None = None, states: str | None = None, **kw) -> dict:
    """Both runs on the same splits, and by how much rules change the macro-F1 of test."""
    out = {}
    for name, rules in (("baseline", False), ("neuro_symbolic", True)):
        out[name] = run(df, label, kb, key, rules=rules, folder=folder and f"{folder}/{name}", states=states and f"{states}/{name}", **kw)[1]
    before = out["baseline"]["test_neural"]["macro_f1"]
    with_rules = out["neuro_symbolic"].get("test_constrained", out["neuro_symbolic"]["test_neural"])["macro_f1"]
    out["macro_f1_gain"] = None if before is None or with_rules is None else with_rules - before
    if folder:
        tables.write_text(json.dumps({"label": label, **out}, ensure_ascii=False, indent=2), f"{folder}/comparison_summary.json")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", help="table with text, a key and labels, and split if it has one")
    p.add_argument("--task", choices=("topic", "action"), default="topic")
    p.add_argument("--label", help="column of labels; by default <task>_label")
    p.add_argument("--key", default="sent_id")
    p.add_argument("--text", default="sentence")
    p.add_argument("--config", help="settings, YAML")
    p.add_argument("--profile")
    p.add_argument("--seed", type=int)
    p.add_argument("--epochs", type=int)
    p.add_argument("--batch", type=int)
    p.add_argument("--rate", type=float)
    p.add_argument("--parts", type=int)
    p.add_argument("--alpha-grid", help="alphas, with commas between")
    p.add_argument("--plain", action="store_true", help="without rules in the loss")
    p.add_argument("--run-experiment", action="store_true", help="without rules and with them, compared")
    p.add_argument("--print-config", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="the settings only")
    p.add_argument("--output", help="by default the settings' output_dir, or outputs/model")
    a = p.parse_args(argv)
    config = tables.runtime_settings(tables.load_settings(a.config), a.task, a.profile) if a.config else {}
    how = settings_of(config, seed=a.seed, epochs=a.epochs, batch=a.batch, rate=a.rate, parts=a.parts)
    grid = neuro.parse_grid(a.alpha_grid) if a.alpha_grid else tuple(config.get("experiment", {}).get("alpha_grid", GRID))
    rules = not a.plain and config.get("neuro_symbolic", {}).get("enabled", True)
    folder = a.output or config.get("paths", {}).get("output_dir", "outputs/model")
    training = config.get("training", {})
    weights = training.get("weight_method", "sqrt_inverse") if training.get("use_class_weights", True) else None
    if a.print_config or a.dry_run:
        print(json.dumps({"task": a.task, "training": vars(how), "alpha_grid": grid, "rules": rules, "class_weights": weights, "output": folder, "config": config}, indent=2, ensure_ascii=False))
    if a.dry_run:
        return
    if not a.input:
        p.error("--input is needed")
    spark = SparkSession.builder.appName("claim-training").getOrCreate()
    df, label, kb = tables.read_table(spark, a.input), a.label or f"{a.task}_label", neuro.knowledge_base(a.task)
    common = {"text": a.text, "how": how, "grid": grid, "weights": weights, "folder": folder, "states": f"{folder}/states"}
    if a.run_experiment:
        compare(df, label, kb, a.key, **common)
    else:
        run(df, label, kb, a.key, rules=rules, **common)


if __name__ == "__main__":
    main()
