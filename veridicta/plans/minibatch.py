"""Training by mini-batches with early stopping, the best epoch's weights, and states from which a stopped run goes on.

A hash of the key and the epoch deals the rows into mini-batches, alike in every run and for any number of parts.  An
epoch's rows are cached, sorted by batch.  Batches of under ``RUN`` rows are taken in runs of that size: a task gets the
state, takes the steps of one run's batches, which follow each other anyway, and hands the state back; it reads no other
rows and holds one batch.  A larger batch is a job by itself: each part gives the sums of gradients of the features that
its rows have, and the driver, which holds only the weights, takes the step.  Either way the driver is sent a few bytes
for each row, and a lost task is that of one run or one batch.
(Barrier tasks that exchange gradients wait in whole seconds: 1.0 s a batch was measured.)
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.functions.expressions import dbl
from veridicta.operators import labels as L
from veridicta.operators import neuro
from veridicta.plans.shipping import ship
from veridicta.plans.training import FEATURES, ROWS, SHARES, LinearModel, Rows, features, losses, softmax

STATE = "settings string, epoch int, step long, loss double, macro_f1 double, micro_f1 double, weights binary, first binary, second binary"
RUN = 1 << 16  # rows of the batches that one task takes steps of
SPREAD = 64  # partitions of an epoch's runs
MOVED = pa.schema([("loss", pa.float64()), ("weights", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
GRADIENT = pa.schema([("part", pa.int32()), ("loss", pa.list_(pa.float64())), ("n", pa.list_(pa.float64())), ("at", pa.list_(pa.int32())), ("grad", pa.binary())])


@dataclass(frozen=True)
class Settings:
    epochs: int = 5
    batch: int = 256
    rate: float = 0.05  # rises over the first ``warmup`` of all steps and falls to 0 behind
    warmup: float = 0.1
    decay: float = 0.01
    patience: int | None = 2  # None: no early stop
    threshold: float = 0.0
    rules_weight: float = 1.0
    seed: int = 42
    parts: int = 4  # tasks of a batch of ``RUN`` rows or more


@dataclass
class State:
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0

    def move(self, gradient: np.ndarray, how: Settings, total: int) -> None:
        """A step of Adam whose decay is apart from the gradient."""
        self.step += 1
        warm = int(how.warmup * total)
        share = self.step / warm if self.step <= warm else (total - self.step + 1) / max(1, total - warm)
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        move = (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        self.weights = self.weights - how.rate * share * (move + how.decay * self.weights)


def best_epoch(scores: list[float | None], patience: int | None, threshold: float = 0.0) -> tuple[int | None, bool]:
    """(number of the first best epoch, whether to stop): training stops behind ``patience`` epochs in a row that don't
    exceed the best before them by more than ``threshold``.  Epochs without a score count for neither."""
    best, bad, stop = None, 0, False
    for i, s in enumerate(scores):
        if s is None:
            continue
        better = best is None or s > scores[best]
        bad = 0 if best is None or (better and s - scores[best] > threshold) else bad + 1
        best = i if better else best
        stop = stop or (patience is not None and bad >= patience)
    return best, stop


def sums(part: pa.RecordBatch, weights: np.ndarray, kinds: list[tuple[str, int]], names: list[str]):
    """(losses, terms, gradients) by kind, summed over rows of features, y, w and truth."""
    loss, n, grad = np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names), *weights.shape))
    for at in range(0, part.num_rows, ROWS):
        p = part.slice(at, ROWS)
        x = Rows(p.column("features"))
        truth = p.column("truth").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        got = losses(softmax(x.times(weights)), p.column("y").to_numpy(), p.column("w").to_numpy(), truth, kinds)
        for i, name in enumerate(names):
            loss[i] += got[name][0]
            n[i] += got[name][1]
            grad[i] += x.transposed_times(got[name][2])
    return loss, n, grad


def prepared(df: DataFrame, key: str, kb: neuro.KnowledgeBase | None, text: str, label: str, weight: str | None) -> DataFrame:
    """(key, features, y, w, truth).  A null text has no features; rows without a label go."""
    d = neuro.truths(df, kb, text) if kb else df.withColumn("truth", F.array().cast("array<double>"))
    w = (F.col(weight) if weight else dbl(1)).cast("double")
    return features(d, text).where(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("key"), "features", F.col(label).cast("int").alias("y"), w.alias("w"), "truth")


def dealt(d: DataFrame, epoch: int, steps: int, seed: int) -> DataFrame:
    """Adds step, the mini-batch of an epoch, and place, the order in it."""
    place = F.xxhash64(F.coalesce("key", F.lit("")), F.lit(seed), F.lit(epoch))
    return d.withColumn("place", place).withColumn("step", F.pmod(F.xxhash64("place"), F.lit(steps)))


def _by_step(batches):
    """(step, the rows of it in this batch), in order."""
    for b in batches:
        step = b.column("step").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield int(step[i]), b.slice(i, j - i)


def _epoch_by_runs(d: DataFrame, state: State, epoch: int, steps: int, how: Settings, kinds, names, by_run: int) -> tuple[State, float]:
    """The steps of an epoch, ``by_run`` a task, one task after the other."""
    share, total, before = np.array([SHARES[x] * (1 if x == "cross_entropy" else how.rules_weight) for x in names]), 0.0, state.step
    runs = -(-steps // by_run)
    rows = dealt(d, epoch, steps, how.seed).withColumn("run", F.floor(F.col("step") / by_run))
    rows = rows.repartition(min(runs, SPREAD), "run").sortWithinPartitions("step", "place", "y", "w", "features").cache()
    for k in range(runs):
        shared = d.sparkSession.sparkContext.broadcast(state)  # three times FEATURES by labels

        def run(batches, shared=shared):
            now, loss = replace(shared.value), 0.0
            for step, parts in groupby(_by_step(batches), lambda x: x[0]):
                got = [sums(b, now.weights, kinds, names) for _, b in parts]
                of, n, grad = (sum(g[i] for g in got) for i in range(3))
                by = share / np.maximum(n, 1)
                loss += float(by @ of)
                now.step = before + step  # a hash may leave a batch without rows
                now.move(np.tensordot(by, grad, 1), how, steps * how.epochs)
            if now.step > shared.value.step:
                yield pa.RecordBatch.from_pylist([{"loss": loss, "weights": now.weights.tobytes(), "first": now.first.tobytes(), "second": now.second.tobytes()}], MOVED)

        found = rows.where(F.col("run") == k).mapInArrow(run, "loss double, weights binary, first binary, second binary").collect()  # a row, or none
        shared.destroy()
        for r in found:
            state = State(*(np.frombuffer(r[c]).reshape(state.weights.shape) for c in ("weights", "first", "second")))
            total += r["loss"]
        state = replace(state, step=before + min(steps, (k + 1) * by_run))
    rows.unpersist()
    return state, total / steps


def _epoch(d: DataFrame, state: State, epoch: int, steps: int, how: Settings, kinds, names, parts: int) -> tuple[State, float]:
    if how.batch < RUN:
        return _epoch_by_runs(d, state, epoch, steps, how, kinds, names, RUN // how.batch)
    share, shape, total = np.array([SHARES[x] * (1 if x == "cross_entropy" else how.rules_weight) for x in names]), state.weights.shape, 0.0
    rows = dealt(d, epoch, steps, how.seed).repartition(parts, "place").sortWithinPartitions("step", "place", "y", "w", "features").cache()
    state = replace(state)
    for step in range(steps):
        shared = d.sparkSession.sparkContext.broadcast(state.weights)  # FEATURES by labels

        def run(batches, shared=shared):
            got = [sums(b, shared.value, kinds, names) for b in batches if b.num_rows]
            if got:
                loss, n, grad = (sum(g[i] for g in got) for i in range(3))
                at = np.flatnonzero(np.abs(grad).sum((0, 2)))
                yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "loss": loss.tolist(), "n": n.tolist(), "at": at.tolist(), "grad": grad[:, at].tobytes()}], GRADIENT)

        found = rows.where(F.col("step") == step).mapInArrow(run, "part int, loss array<double>, n array<double>, at array<int>, grad binary").collect()  # a row a part
        shared.destroy()
        if not found:  # a hash may leave a batch without rows
            state.step += 1
            continue
        loss, n, grad = np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names), *shape))
        for r in sorted(found, key=lambda r: r["part"]):
            loss += r["loss"]
            n += r["n"]
            grad[:, r["at"]] += np.frombuffer(r["grad"]).reshape(len(names), len(r["at"]), shape[1])
        by = share / np.maximum(n, 1)
        total += float(by @ loss)
        state.move(np.tensordot(by, grad, 1), how, steps * how.epochs)
    rows.unpersist()
    return state, total / steps


def _finished(spark: SparkSession, folder: str | None, epochs: int, settings: str) -> list:
    """The rows of the epochs that a run before has finished, without the states."""
    out = []
    for e in range(epochs if folder else 0):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch={e}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            break
        out.append(spark.read.parquet(f"{folder}/epoch={e}").select("loss", "macro_f1", "micro_f1", "settings").first())
        if out[-1]["settings"] != settings:
            raise ValueError(f"{folder} holds a run with other settings or rows: {out[-1]['settings']}, now {settings}")
    return out


def _state(spark: SparkSession, folder: str, epoch: int, shape: tuple[int, int]) -> State:
    r = spark.read.parquet(f"{folder}/epoch={epoch}").first()
    return State(*(np.frombuffer(r[c]).reshape(shape) for c in ("weights", "first", "second")), r["step"])


def fit(df: DataFrame, val: DataFrame, labels: tuple[str, ...], key: str, kb: neuro.KnowledgeBase | None = None, text: str = "text", label: str = "label_id", weight: str | None = None, how: Settings = Settings(), folder: str | None = None) -> tuple[LinearModel, list[dict]]:
    """The model of the epoch with the best macro-F1 on ``val``, and a row for each epoch: epoch, loss, macro_f1,
    micro_f1, best.  With ``folder``, in a file system that all share, each epoch's state stays there, and a run goes on
    behind the last one; other settings (but for patience and parts) or another number of rows are an error.

    Without rows to learn from the weights stay zero; without rows in ``val`` the last epoch is taken."""
    spark = df.sparkSession
    ship(spark)
    shape = (FEATURES + 1, len(labels))
    d = prepared(df, key, kb, text, label, weight).cache()
    seen = val.select(text, F.col(label).cast("int").alias("y")).where("y IS NOT NULL").cache()
    kinds = [(c.kind, labels.index(c.target)) for c in kb.rules] if kb else []
    names = list(SHARES) if kb else ["cross_entropy"]
    n = d.count()
    steps = max(1, -(-n // how.batch))
    settings = f"{replace(how, parts=0, patience=None, threshold=0.0)} {n} rows {len(kinds)} rules {','.join(labels)}"
    history = [(r["loss"], r["macro_f1"], r["micro_f1"]) for r in _finished(spark, folder, how.epochs, settings)]
    state = _state(spark, folder, len(history) - 1, shape) if history else State(*(np.zeros(shape) for _ in range(3)))
    best, stop = best_epoch([h[1] for h in history], how.patience, how.threshold)
    weights = state.weights if best is None else _state(spark, folder, best, shape).weights
    for epoch in range(len(history), how.epochs):
        if stop:
            break
        state, loss = _epoch(d, state, epoch, steps, how, kinds, names, how.parts)
        scored = LinearModel(labels, state.weights).logits(seen, text).withColumn("p", neuro.arg_max(F.col("logits")))
        f1 = L.f1_summary(scored, "y", "p").first()
        history.append((loss, f1["macro_f1"], f1["micro_f1"]))
        if folder:
            row = (settings, epoch, state.step, *history[-1], *(x.tobytes() for x in (state.weights, state.first, state.second)))
            spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        best, stop = best_epoch([h[1] for h in history], how.patience, how.threshold)
        if best is None or best == epoch:
            weights = state.weights
    d.unpersist()
    seen.unpersist()
    return LinearModel(tuple(labels), weights), [{"epoch": i, "loss": h[0], "macro_f1": h[1], "micro_f1": h[2], "best": i == best} for i, h in enumerate(history)]
