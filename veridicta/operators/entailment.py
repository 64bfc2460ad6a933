"""Does evidence support a claim?  Words are aligned by their vectors, and a fitted decision reads the alignment.

Each word of the claim takes the word of the evidence that is nearest to it (the same word: 1; words without a vector:
only the same word counts), weighed by its idf.  What is told of a pair: how well the claim's words are covered, how
well the worst is, how many are the same, the same the other way round, which numbers of the claim the evidence has, and
whether only one of the two negates.  A multinomial logistic regression over these gives contradiction, neutral and
entailment; it is a scorer like any other.

Null and empty texts count as texts without words, which nothing covers and which cover nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridicta.operators.vectors import SentenceVectors, words_of
from veridicta.plans.shipping import ship
from veridicta.streaming.scorers import nli_scorer

LABELS = ("contradiction", "neutral", "entailment")
NEGATIONS = frozenset("not no never none without cannot không chưa chẳng nicht kein keine nie ne pas jamais sans nunca sin".split())
FEATURES = ("covered", "worst", "same", "covered_back", "same_back", "numbers", "missing_numbers", "negated")
MOST = 4000  # texts to make pairs of
AT_ONCE, CELLS = 512, 1 << 13  # pairs a batch; pairs of words that are aligned at once
LEAST_NEAR = 0.3  # nearer words count as aligned, others not at all
_number = re.compile(r"(?<!\w)\d+(?:[.,]\d+)*")


class Alignment:
    """Features of pairs (evidence, claim), many at a time."""

    def __init__(self, vectors: SentenceVectors, negations: frozenset[str] = NEGATIONS):
        self.number, self.negations = {t: i for i, t in enumerate(vectors.terms)}, negations
        v = vectors.axes * vectors.sizes
        self.unit = np.concatenate([v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None], np.zeros((1, v.shape[1]))])  # words without a vector: the last
        self.weight = np.append(vectors.idf, float(vectors.idf.max(initial=1.0)))

    def _read(self, text: str | None, others: dict[str, int]) -> tuple[list[int], set[str], bool]:
        """The numbers of its distinct plain words (words without a vector get theirs from ``others``), the figures in it, and
        whether it negates."""
        words = dict.fromkeys(words_of(text))
        plain = [self.number.get(w, -1) for w in words if w not in self.negations and not w.isdigit()]
        if -1 in plain:
            some = (w for w in words if w not in self.negations and not w.isdigit() and w not in self.number)
            plain = [others.setdefault(next(some), len(self.number) + len(others)) if x < 0 else x for x in plain]
        return plain, set(_number.findall(text or "")), not self.negations.isdisjoint(words)

    def _one_way(self, near: np.ndarray, weight: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = weight.sum(axis=1)
        total = np.where(total > 0, total, 1)
        worst = np.where(there, near, np.inf).min(axis=1)
        return (near * weight).sum(axis=1) / total, np.where(there.any(axis=1), worst, 0), ((near == 1) * weight).sum(axis=1) / total

    def _aligned(self, evidence: list[list[int]], claims: list[list[int]]) -> np.ndarray:
        """covered, worst, same, covered_back, same_back of pairs; how near the nearest word of the other text is, 1 for the
        same word."""
        n = len(self.number)

        def padded(rows, fill):
            out = np.full((len(rows), max(1, *map(len, rows))), fill)
            for i, x in enumerate(rows):
                out[i, : len(x)] = x
            return out

        e, c = padded(evidence, -2), padded(claims, -1)
        vectors = lambda x: self.unit[np.where((x < 0) | (x > n), n, x)]
        near = vectors(c) @ vectors(e).transpose(0, 2, 1)
        near = np.where(near >= LEAST_NEAR, np.minimum(near, 1), 0)
        near[c[:, :, None] == e[:, None, :]] = 1
        weight = lambda x: np.where(x < 0, 0, self.weight[np.clip(x, 0, n)])
        covered, worst, same = self._one_way(near.max(axis=2), weight(c), c >= 0)
        back, _, same_back = self._one_way(near.max(axis=1), weight(e), e >= 0)
        return np.column_stack([covered, worst, same, back, same_back])

    def features(self, pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
        """A row a pair.  A text that is in several is read once; pairs of like lengths are aligned at once."""
        others: dict[str, int] = {}
        read = {t: self._read(t, others) for t in {x for p in pairs for x in p}}
        e, c = ([read[x] for x in side] for side in (zip(*pairs, strict=True) if pairs else ((), ())))
        out = np.zeros((len(pairs), len(FEATURES)))
        size = np.array([(max(len(x[0]), len(y[0]), 1)) for x, y in zip(e, c, strict=True)], np.int64)
        order, i = np.argsort(size, kind="stable"), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * size[order[j]] ** 2 <= CELLS:
                j += 1
            at = order[i:j]
            out[at, :5] = self._aligned([e[k][0] for k in at], [c[k][0] for k in at])
            i = j
        for k, ((_, held, one), (_, told, other)) in enumerate(zip(e, c, strict=True)):
            out[k, 5:] = bool(told), len(told - held) / max(len(told), 1), one != other
        return out


class Entailment(NamedTuple):
    vectors: SentenceVectors
    weights: np.ndarray  # features and a constant x labels

    def scorer(self, negations: frozenset[str] = NEGATIONS) -> Callable[[DataFrame], DataFrame]:
        """Of frames with claim_text and evidence_text; adds nli_label, entailment, contradiction, neutral."""

        def load():
            a = Alignment(self.vectors, negations)
            return lambda pairs: (np.column_stack([a.features(pairs), np.ones(len(pairs))]) @ self.weights).tolist()

        return nli_scorer(load, AT_ONCE)


def with_features(pairs: DataFrame, vectors: SentenceVectors, name: str = "features", negations: frozenset[str] = NEGATIONS) -> DataFrame:
    ship(pairs.sparkSession)
    shared = pairs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<double>")
    def told(evidence: pd.Series, claim: pd.Series) -> pd.Series:
        a = Alignment(shared.value, negations)
        text = lambda t: t if isinstance(t, str) else None
        return pd.Series(list(a.features([(text(e), text(c)) for e, c in zip(evidence, claim, strict=True)])), dtype=object)

    return pairs.withColumn(name, told("evidence_text", "claim_text"))


def fit(pairs: DataFrame, vectors: SentenceVectors, label: str = "label", negations: frozenset[str] = NEGATIONS) -> Entailment:
    """On (evidence_text, claim_text, label); labels other than the three are left out, those that none has stay unlikely."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    number = F.array_position(F.array(*map(F.lit, LABELS)), F.col(label)) - 1
    d = with_features(pairs.where(F.col(label).isin(*LABELS)), vectors, "x", negations).select(array_to_vector("x").alias("features"), number.cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", maxIter=200, regParam=1e-4).fit(d.cache())
    d.unpersist()
    found, start = model.coefficientMatrix.toArray(), np.array(model.interceptVector.toArray())
    weights = np.zeros((len(FEATURES) + 1, len(LABELS)))
    weights[-1, len(found) :] = -50.0
    weights[:-1, : len(found)], weights[-1, : len(found)] = found.T, start
    return Entailment(vectors, weights)


def sample(df: DataFrame, text: str = "sentence", most: int = MOST) -> DataFrame:
    """The same ``most`` distinct texts at every run, to fit on; all where there are fewer."""
    return df.dropDuplicates([text]).orderBy(F.xxhash64(text), text).limit(most)


def made_pairs(df: DataFrame, vectors: SentenceVectors, text: str = "sentence", other: str = "ctx_next", negation: str = "not") -> DataFrame:
    """(evidence_text, claim_text, label) from sentences and others beside them: shortened with words changed for near ones
    (entailment), negated or with other numbers (contradiction), and the other sentence (neutral).  The same at every run."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    schema = "evidence_text string, claim_text string, label string"

    def run(parts):
        v = shared.value
        a = Alignment(v)

        @cache
        def other_word(w: str) -> str:
            """The word nearest to it, if that is near."""
            near = a.unit @ a.unit[a.number[w]]
            near[a.number[w]] = -1
            return v.terms[int(near.argmax())] if near.max() >= 2 * LEAST_NEAR else w

        for p in parts:
            rows = []
            for t, o in zip(p[text], p[other], strict=True):
                if not isinstance(t, str) or len(words_of(t)) < 4:
                    continue
                rng = np.random.default_rng(list(t.encode()[:64]))
                said = t.split()
                short = [w for w in said if rng.random() > 0.25] or said
                for i, w in enumerate(short):
                    if w.lower() in a.number and rng.random() < 0.3:
                        short[i] = other_word(w.lower())
                rows.append((t, " ".join(short), "entailment"))
                turned = _number.sub(lambda m: str(int(re.sub(r"\D", "", m[0])) * 3 + 7), " ".join(short)) if _number.search(" ".join(short)) and rng.random() < 0.5 else None
                at = int(rng.integers(0, len(short)))
                rows.append((t, turned or " ".join([*short[:at], negation, *short[at:]]), "contradiction"))
                if isinstance(o, str) and o.strip() and o != t:
                    rows.append((t, o, "neutral"))
            yield pd.DataFrame(rows, columns=["evidence_text", "claim_text", "label"])

    return df.select(text, other).mapInPandas(run, schema)
