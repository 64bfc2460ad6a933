"""Training of a sentence classifier with rules in its loss, its evaluation on the splits, saving and loading.

The model is linear over hashed words, standing in for a fine-tuned encoder.  Its loss is weighted cross entropy and,
for the neuro-symbolic run, the semantic losses of a knowledge base: exactly one label, implications and negations of
the rules that hold for a sentence.  Every step is one pass over the training rows: tasks sum gradients of their rows,
``SUMS`` groups add these up, and the driver, which holds only the weights, takes an Adam step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.functions.expressions import dbl
from veridicta.operators import labels as L
from veridicta.operators import neuro
from veridicta.plans.shipping import ship
from veridicta.sources import tables

FEATURES, STEPS, RATE, SUMS, ROWS = 1 << 12, 40, 0.15, 8, 4096
EPS = 1e-7


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds features: the numbers of the words' places."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return df.withColumn("features", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int")))


class Rows:
    """Rows of word counts of length 1, and a 1 for the constant, of which only what isn't zero is held: work goes with the
    words, not with rows times ``FEATURES``."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = len(n)
        cell = np.repeat(np.arange(self.size), n) * (FEATURES + 1) + column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        cell, count = np.unique(cell, return_counts=True)
        self.row, self.feature = cell // (FEATURES + 1), cell % (FEATURES + 1)
        self.value = count / np.maximum(np.sqrt(np.bincount(self.row, count * count, self.size)), 1)[self.row]

    def __len__(self) -> int:
        return self.size

    def times(self, weights: np.ndarray) -> np.ndarray:
        each = lambda c: np.bincount(self.row, self.value * weights[self.feature, c], self.size) + weights[-1, c]
        return np.stack([each(c) for c in range(weights.shape[1])], 1)

    def transposed_times(self, right: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(self.feature, self.value * right[self.row, c], FEATURES + 1) for c in range(right.shape[1])], 1)
        out[-1] += right.sum(0)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def losses(p: np.ndarray, y: np.ndarray, weight: np.ndarray, truth: np.ndarray, rules: list[tuple[str, int]]):
    """(kind -> sum of losses, number of terms, gradient by logits of the sum), for rows of probabilities."""
    rows = np.arange(len(p))
    d = p * weight[:, None]
    d[rows, y] -= weight
    out = {"cross_entropy": (-(weight * np.log(np.maximum(p[rows, y], EPS))).sum(), weight.sum(), d)}

    def through(g):  # from probabilities to logits
        return p * (g - (p * g).sum(1, keepdims=True))

    q = np.clip(p, EPS, 1 - EPS)
    rest, odds = np.prod(1 - q, 1, keepdims=True), q / (1 - q)
    one = rest * odds.sum(1, keepdims=True) + EPS
    by_p = rest / (1 - q) * (1 - (odds.sum(1, keepdims=True) - odds))
    out["exactly_one"] = (-np.log(one).sum(), len(p), through(-by_p / one))
    for kind in ("implication", "negation"):
        total, n, g = 0.0, 0, np.zeros_like(p)
        for i, (of, k) in enumerate(rules):
            if of == kind:
                t, on = truth[:, i], truth[:, i] > 0
                x = np.maximum(p[:, k] if kind == "implication" else 1 - p[:, k], EPS)
                total -= (t * np.log(x)).sum()
                n += int(on.sum())
                g[:, k] += -t / x * (1 if kind == "implication" else -1)
        out[kind] = (total, n, through(g))
    return out


SHARES = {"cross_entropy": 1.0, "exactly_one": 1.0, "implication": 0.5, "negation": 0.5}


@dataclass
class LinearModel:
    labels: tuple[str, ...]
    weights: np.ndarray

    def logits(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds logits, an array of doubles."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.weights)  # FEATURES by labels
        d = features(df, text)
        names = df.columns

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = Rows(part.column(len(names))).times(shared.value)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], rows], [*names, "logits"])

        return d.mapInArrow(run, df.withColumn("logits", F.array(dbl(0))).schema)

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(i, self.weights[i].tolist()) for i in range(len(self.weights))]
        tables.write_parquet(spark.createDataFrame(rows, "feature int, weights array<double>").coalesce(1), f"{folder}/weights.parquet")
        tables.write_parquet(spark.createDataFrame(list(enumerate(self.labels)), "id int, label string").coalesce(1), f"{folder}/labels.parquet")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LinearModel:
        """At most FEATURES + 1 rows."""
        names = [r["label"] for r in tables.read_table(spark, f"{folder}/labels.parquet").orderBy("id").collect()]
        rows = tables.read_table(spark, f"{folder}/weights.parquet").orderBy("feature").collect()
        return cls(tuple(names), np.array([r["weights"] for r in rows]))


def train(df: DataFrame, labels: tuple[str, ...], kb: neuro.KnowledgeBase | None = None, rules_weight: float = 1.0, text: str = "text", label: str = "label_id", weight: str | None = None, steps: int = STEPS) -> LinearModel:
    """Fits on (text, label_id).  ``kb``: the neuro-symbolic run; without it cross entropy alone."""
    ship(df.sparkSession)
    k = len(labels)
    d = neuro.truths(df, kb, text) if kb else df.withColumn("truth", F.array().cast("array<double>"))
    d = features(d, text).select("features", F.col(label).cast("int").alias("y"), (F.col(weight) if weight else dbl(1)).cast("double").alias("w"), "truth").cache()
    kinds = [(c.kind, labels.index(c.target)) for c in kb.rules] if kb else []
    names = list(SHARES) if kb else ["cross_entropy"]
    w = np.zeros((FEATURES + 1, k))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def add(t: pa.Table) -> pa.Table:
        grad = sum(np.frombuffer(x.as_py()) for x in t.column("grad"))
        n = np.array(t.column("n").to_pylist()).sum(0)
        return pa.table([pa.array([n.tolist()], pa.list_(pa.float64())), pa.array([grad.tobytes()], pa.binary())], ["n", "grad"])

    for step in range(1, steps + 1):
        shared = df.sparkSession.sparkContext.broadcast(w)

        def run(batches, shared=shared):
            n, grad = np.zeros(len(names)), np.zeros((len(names), FEATURES + 1, k))
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = Rows(part.column(0))
                    truth = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                    got = losses(softmax(x.times(shared.value)), part.column(1).to_numpy(), part.column(2).to_numpy(), truth, kinds)
                    for i, name in enumerate(names):
                        n[i] += got[name][1]
                        grad[i] += x.transposed_times(got[name][2])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([n.tolist()], pa.list_(pa.float64())), pa.array([grad.tobytes()], pa.binary())], ["g", "n", "grad"])

        sums = d.mapInArrow(run, "g int, n array<double>, grad binary").groupBy("g").applyInArrow(add, "n array<double>, grad binary").collect()  # SUMS rows
        n = sum(np.array(r["n"]) for r in sums)
        grad = sum(np.frombuffer(r["grad"]).reshape(len(names), FEATURES + 1, k) for r in sums)
        shared.destroy()
        share = np.array([SHARES[x] * (1 if x == "cross_entropy" else rules_weight) for x in names])
        g = np.tensordot(share / np.maximum(n, 1), grad, 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    d.unpersist()
    return LinearModel(tuple(labels), w)


def predict(model: LinearModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Adds logits and predicted, the model's own label."""
    name = F.array(*map(F.lit, model.labels))[neuro.arg_max(F.col("logits"))]
    return model.logits(df, text).withColumn("predicted", name)


def evaluate(model: LinearModel, df: DataFrame, label: str, kb: neuro.KnowledgeBase | None = None, alpha: float = 0.5, text: str = "text") -> DataFrame:
    """split, run, macro_f1, micro_f1 for each split of a frame with split; with ``kb`` also the fusion with rules."""
    d = predict(model, df, text)
    out = L.f1_summary(d, label, "predicted", ("split",)).withColumn("run", F.lit("model"))
    if kb:
        fused = neuro.fuse(neuro.truths(d, kb, text), kb, "logits", alpha)
        out = out.unionByName(L.f1_summary(fused, label, "label", ("split",)).withColumn("run", F.lit("model_and_rules")))
    return out


def train_and_evaluate(df: DataFrame, label: str, labels: tuple[str, ...], key: str, kb: neuro.KnowledgeBase | None = None, text: str = "text", folder: str | None = None, **kw) -> tuple[LinearModel, DataFrame]:
    """Splits by label, fits on train, and scores every split; ``folder`` keeps the model and its scores."""
    d = L.stratified_split(L.encode(df, label, labels), label, key) if "split" not in df.columns else L.encode(df, label, labels)
    weights = L.class_weights(d.where("split = 'train'"), label, labels, "sqrt_inverse").select(F.col("label").alias(label), F.col("weight").alias("__w"))
    model = train(d.where("split = 'train'").join(F.broadcast(weights), label), labels, kb, text=text, weight="__w", **kw)  # a row a label
    scores = evaluate(model, d, label, kb, text=text)
    if folder:
        model.save(df.sparkSession, folder)
        tables.write_csv(scores, f"{folder}/scores.csv", one_file=True)
    return model, scores
