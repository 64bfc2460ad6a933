"""Mixing by constraints that overlap, such as words by source and words by language, by entropy balancing; DataFrame
functions only.

Each column's constrained values have a share of the words to take and a multiplier; a document's rate is exp of the sum
of its values' multipliers, at most ``cap``.  The dual, ``sum(size * exp(l)) - sum(target * multiplier)`` (linear behind
the cap), is convex.  Documents with the same values have one rate, so words are summed once, by combinations of values;
each Newton step is one aggregation over these for gradient and curvature, and one for the dual at halved steps.  The
driver holds a number for each constrained value and the curvature's square of them: ``VALUES`` bounds these.  Rates
become copies as in ``entropy_mix``, within each combination.

A value without a share is free, as null is unless None has one.  Null text: no words.  Repeated rows are rows of their
own.  An empty table, or one without words, takes nothing.  A share for a value without words, or shares that no rates up
to ``cap`` meet, are an error.  The input's columns keep their names and values; what is added (size, rate, copies, taken)
replaces theirs of that name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridicta.llm.common import cut, unused
from veridicta.llm.entropy_mix import CAP, _mixed, words_in

VALUES = 1000  # constrained values of all columns
STEPS, HALVES, CLOSE = 100, 20, 1e-9  # of all words
STUCK = 8  # steps that bring nothing nearer
FLAT = 0.1  # of the curvature is left behind the cap, where the dual is linear, so that a step beyond it is taken back
_ADDED = ("size", "rate", "copies", "taken")


def _numbers(wants: dict[str, dict], value) -> dict[str, Column]:
    """The number of each column's value among all constrained ones; null if it is free."""
    out, at = {}, 0
    for c, shares in wants.items():
        n = F
        for v in shares:
            n = n.when(value(c).isNull() if v is None else value(c) == F.lit(v), at)
            at += 1
        out[c] = n.otherwise(F.lit(None).cast("int")) if shares else F.lit(None).cast("int")
    return out


def _sum(numbers, x: np.ndarray) -> Column:
    all_ = F.array(*(F.lit(float(v)) for v in x))
    total = F.lit(0.0)
    for n in numbers:
        total = total + F.coalesce(F.get(all_, n), F.lit(0.0))
    return total


def multipliers(cells: DataFrame, wants: dict[str, dict], cap: float = CAP) -> np.ndarray:
    """The dual's solution, in the order of ``wants``, for cells of (k0, k1, ..., size): the columns of ``wants`` in turn."""
    told = [(c, v, float(s)) for c, shares in wants.items() for v, s in shares.items()]
    if not 0 < len(told) <= VALUES:
        raise ValueError(f"{len(told)} constrained values; 1 to {VALUES} can be")
    target, top = np.array([s for *_, s in told]), math.log(cap)
    total = cells.agg(F.sum("size")).first()[0]
    x = np.zeros(len(told))
    if not total:
        return x
    place = {c: f"k{i}" for i, c in enumerate(wants)}
    numbers = _numbers(wants, lambda c: F.col(place[c]))
    names = [f"n{i}" for i in range(len(wants))]
    d = cut(cells.where("size > 0").select(*(n.alias(k) for k, n in zip(names, numbers.values(), strict=True)), (F.col("size") / F.lit(float(total))).alias("part")))
    cols = [F.col(n) for n in names]
    seen = {r[0] for r in d.select(F.explode(F.array(*cols))).distinct().collect()}  # up to VALUES
    for i, (c, v, s) in enumerate(told):
        if s > 0 and i not in seen:
            raise ValueError(f"{c} {v!r} has no words to take")
        if s <= 0:
            raise ValueError(f"{c} {v!r}: a share must be above 0; leave its rows out instead")
    pairs = F.explode(F.array(*(F.struct(a.alias("i"), b.alias("j")) for a in cols for b in cols)))
    gaps: list[float] = []
    for _ in range(STEPS):
        l = _sum(cols, x)
        rate = F.exp(F.least(l, F.lit(top)))
        s = d.select(pairs.alias("p"), (F.col("part") * rate).alias("r"), (F.col("part") * F.when(l < top, rate).otherwise(rate * FLAT)).alias("h")).where("p.i IS NOT NULL AND p.j IS NOT NULL")
        rows = s.groupBy("p.i", "p.j").agg(F.sum("r").alias("r"), F.sum("h").alias("h")).collect()  # a row a pair of values
        gradient, curvature = -target, np.zeros((len(x), len(x)))
        for r in rows:
            curvature[r["i"], r["j"]] = r["h"]
            if r["i"] == r["j"]:
                gradient[r["i"]] += r["r"]
        gap = np.abs(gradient).max()
        if gap <= CLOSE:
            return x
        gaps.append(gap)
        if len(gaps) > STUCK and min(gaps[-STUCK:]) > 0.9 * min(gaps[:-STUCK]):
            break
        move = -np.linalg.lstsq(curvature + 1e-12 * np.eye(len(x)), gradient, rcond=1e-10)[0]  # shares of two columns that both sum to 1 depend on each other
        halves = [0.5**k for k in range(HALVES)]
        values = []
        for t in (0.0, *halves):
            m = _sum(cols, x + t * move)
            values.append(F.sum(F.col("part") * F.when(m <= top, F.exp(m)).otherwise(F.lit(cap) * (m - top + 1))))
        dual = np.array(d.agg(*values).first()) - np.array([target @ (x + t * move) for t in (0.0, *halves)])
        slope = float(gradient @ move)
        good = next((t for t, v in zip(halves, dual[1:], strict=True) if v <= dual[0] + 1e-4 * t * slope + 1e-15), None)
        if good is None or slope > -1e-18:
            break
        x = x + good * move
    if gap > 1e-6:
        c, v, s = told[int(np.abs(gradient).argmax())]
        raise ValueError(f"no rates up to {cap} meet the shares: {c} {v!r} is off by {gap:.2g} of all words")
    return x


def balance(documents: DataFrame, wants: dict[str, dict], cap: float = CAP) -> DataFrame:
    """All rows with size, rate, copies and taken.  ``wants``: column -> value -> share of all words of the input."""
    keep = [c for c in documents.columns if c not in _ADDED or c in ("doc_id", "text")]
    keys = {c: f"k{i}" for i, c in enumerate(wants)}
    mine = dict(zip(keep, unused((*_ADDED, "source_size", "target", "doc_id", "text", "source", "weight"), *(f"in{i}" for i in range(len(keep)))), strict=True))
    cell = F.struct(*(F.col(f"`{c}`").alias(k) for c, k in keys.items()))
    d = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in mine.items() if c not in ("doc_id", "text")), "doc_id", "text", cell.alias("source"))
    cells = documents.select(*(F.col(f"`{c}`").alias(k) for c, k in keys.items()), words_in().alias("size")).groupBy(*keys.values()).agg(F.sum("size").alias("size"))
    x = multipliers(cells, wants, cap)
    numbers = _numbers(wants, lambda c: F.col("source")[keys[c]])
    rate = F.exp(F.least(_sum(numbers.values(), x), F.lit(math.log(cap))))

    def plan_of(sources: DataFrame) -> DataFrame:
        return sources.withColumn("weight", F.lit(1.0)).withColumn("target", F.col("source_size") * rate)

    names = {c: c if c in ("doc_id", "text") else n for c, n in mine.items()}
    return _mixed(d, None, cap, [*names.values(), "source"], plan_of).select(*(F.col(n).alias(c) for c, n in names.items()), *_ADDED)
