"""Sentence vectors from the corpus itself: latent semantic analysis by a distributed randomized SVD.

Terms are words; a sentence's row has (1 + ln(count)) * idf for each of its terms, scaled to length 1.  Words that occur
in the same sentences get near vectors, so sentences that share few words can be near too.

The matrix has a row a sentence and stays where the sentences are; only its right side, ``MOST_TERMS`` x ``DIMENSIONS``
numbers at most whatever the corpus, is held whole.  From a Gaussian start, each pass multiplies by the transposed
matrix and the matrix (a task adds up its rows' products, groups of tasks add up theirs, the driver the groups') and
makes the columns orthonormal; a last pass gives the small matrix whose eigenvectors turn the basis into the singular
vectors.  A sentence's vector is its row times these.

Null and empty texts, and texts without a known term, have zero vectors.  Ties among the most frequent terms go by the
term.  An empty corpus has no terms and gives zero vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.functions.expressions import free
from veridicta.plans.shipping import ship
from veridicta.sources import tables

MOST_TERMS, DIMENSIONS, EXTRA, PASSES = 20_000, 64, 16, 4
LEAST, MOST_SHARE = 2, 0.2  # texts that a term is in: at least so many, and at most this share
GROUPS, ROWS = 8, 256
TASKS = 24  # that add up sums of MOST_TERMS rows: these are what is exchanged, so with more input a task has more texts
WORD = r"(?U)\w\w+"
_word = re.compile(r"\w\w+")


class SentenceVectors(NamedTuple):
    terms: tuple[str, ...]
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    sizes: np.ndarray  # singular values

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(i, t, float(self.idf[i]), self.axes[i].tolist()) for i, t in enumerate(self.terms)]
        tables.write_parquet(spark.createDataFrame(rows, "id int, term string, idf double, axes array<double>").coalesce(1), f"{folder}/terms.parquet")
        tables.write_parquet(spark.createDataFrame([(self.sizes.tolist(),)], "sizes array<double>"), f"{folder}/sizes.parquet")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SentenceVectors:
        """At most ``MOST_TERMS`` rows."""
        rows = tables.read_table(spark, f"{folder}/terms.parquet").orderBy("id").collect()
        sizes = np.array(tables.read_table(spark, f"{folder}/sizes.parquet").first()["sizes"])
        return cls(tuple(r["term"] for r in rows), np.array([r["idf"] for r in rows]), np.array([r["axes"] for r in rows]).reshape(len(rows), len(sizes)), sizes)


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


class _Rows:
    """Texts to sparse rows: (row, term, weight) of all texts of a batch."""

    def __init__(self, terms: tuple[str, ...], idf: np.ndarray):
        self.number, self.idf = {t: i for i, t in enumerate(terms)}, idf

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many known words each text has, and their numbers, ascending within a text."""
        get, each = self.number.get, []
        for t in texts:
            known = [n for n in map(get, words_of(t)) if n is not None]
            known.sort()
            each.append(known)
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return counts, np.fromiter(chain.from_iterable(each), np.int64, int(counts.sum()))

    def weighed(self, counts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(len(self.number), 1)
        cell = np.repeat(np.arange(len(counts)), counts) * size + numbers
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        count, cell = np.diff(begin, append=len(cell)), cell[begin]
        row, term = cell // size, cell % size
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight * weight, len(counts)))
        return row, term, weight / norm[row]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.weighed(*self.numbers(texts))

    def times(self, n: int, rows: tuple[np.ndarray, np.ndarray, np.ndarray], right: np.ndarray) -> np.ndarray:
        """Of ``n`` texts' rows with ``right``."""
        row, term, weight = rows
        out = np.zeros((n, right.shape[1]))
        if len(row):
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            parts = right[term]
            parts *= weight[:, None]
            out[row[begin]] = np.add.reduceat(parts, begin)
        return out

    def vectors(self, texts: list[str | None], axes: np.ndarray) -> np.ndarray:
        if not self.number:
            return np.zeros((len(texts), axes.shape[1]))
        parts = [texts[i : i + ROWS] for i in range(0, len(texts), ROWS)]
        return np.concatenate([np.zeros((0, axes.shape[1])), *(self.times(len(x), self.of(x), axes) for x in parts)])


def vocabulary(df: DataFrame, text: str, most: int = MOST_TERMS, least: int = LEAST, share: float = MOST_SHARE) -> tuple[tuple[str, ...], np.ndarray]:
    """The ``most`` terms in most texts, in that order, and their idf."""
    n = df.count()
    each = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)))).alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= max(least, share * n)))
    rows = counts.orderBy(F.col("n").desc(), "term").limit(most).collect()
    return tuple(r["term"] for r in rows), np.log((1 + n) / (1 + np.array([r["n"] for r in rows], np.float64))) + 1


def _partial(df: DataFrame, run) -> DataFrame:
    """A row of sums a task, of ``TASKS`` tasks at most."""
    return df.coalesce(TASKS).mapInArrow(run, "g int, sums binary")


def _numbered(df: DataFrame, text: str, terms: tuple[str, ...], idf: np.ndarray) -> DataFrame:
    """A row a batch of texts: how many known words each has, and their numbers."""
    shared = df.sparkSession.sparkContext.broadcast((terms, idf))
    kind = np.uint16 if len(terms) <= 1 << 16 else np.uint32

    def run(batches):
        rows = _Rows(*shared.value)
        for b in batches:
            counts, numbers = rows.numbers(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (counts.astype(np.uint32), numbers.astype(kind))], ["counts", "numbers"])

    return df.select(text).mapInArrow(run, "counts binary, numbers binary")


def _summed(numbered: DataFrame, terms: tuple[str, ...], idf: np.ndarray, right: np.ndarray, small: bool) -> np.ndarray:
    """A'A right, or with ``small`` right'A'A right, A being the matrix of all texts."""
    shared = numbered.sparkSession.sparkContext.broadcast((terms, idf, right))
    shape = (right.shape[1] if small else len(terms), right.shape[1])
    kind = np.uint16 if len(terms) <= 1 << 16 else np.uint32

    def run(batches):
        terms, idf, right = shared.value
        rows, total = _Rows(terms, idf), np.zeros(shape)
        for b in batches:
            for counts, numbers in zip(b.column(0), b.column(1), strict=True):
                counts, numbers = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64), np.frombuffer(numbers.as_py(), kind).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(counts)])
                for i in range(0, len(counts), ROWS):
                    n = len(counts[i : i + ROWS])
                    row, term, weight = of = rows.weighed(counts[i : i + n], numbers[at[i] : at[i + n]])
                    y = rows.times(n, of, right)
                    if small:
                        total += y.T @ y
                    elif len(row):
                        by = np.argsort(term, kind="stable")
                        begin = np.flatnonzero(np.diff(term[by], prepend=-1))
                        parts = y[row[by]]
                        parts *= weight[by][:, None]
                        total[term[by][begin]] += np.add.reduceat(parts, begin)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for x in t.column("sums"):
            total += np.frombuffer(x.as_py()).reshape(shape)
        return pa.table([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = _partial(numbered, run).groupBy("g").applyInArrow(add, "sums binary").collect()  # GROUPS rows
    shared.destroy()
    return sum((np.frombuffer(r["sums"]).reshape(shape) for r in parts), np.zeros(shape))


def fit(df: DataFrame, text: str = "sentence", dimensions: int = DIMENSIONS, passes: int = PASSES, seed: int = 42, **kw) -> SentenceVectors:
    ship(df.sparkSession)
    terms, idf = vocabulary(df, text, **kw)
    k = min(dimensions, len(terms))
    if not k:
        return SentenceVectors((), np.zeros(0), np.zeros((0, dimensions)), np.zeros(dimensions))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), min(k + EXTRA, len(terms)))))[0]
    numbered = _numbered(df, text, terms, idf).persist(StorageLevel.DISK_ONLY)  # texts are cut up once, not by each pass
    for _ in range(passes):
        basis = np.linalg.qr(_summed(numbered, terms, idf, basis, False))[0]
    values, turn = np.linalg.eigh(_summed(numbered, terms, idf, basis, True))
    numbered.unpersist()
    first = np.argsort(-values, kind="stable")[:k]
    axes = basis @ turn[:, first]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1, 1)  # the same signs at every run
    sizes = np.sqrt(np.maximum(values[first], 0))
    return SentenceVectors(terms, idf, np.pad(axes, ((0, 0), (0, dimensions - k))), np.pad(sizes, (0, dimensions - k)))


def embed(df: DataFrame, model: SentenceVectors, text: str = "sentence", name: str = "embedding") -> DataFrame:
    """Adds the texts' vectors (array<double>)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        rows = _Rows(m.terms, m.idf)
        for p in parts:
            yield pd.Series(list(rows.vectors([t if isinstance(t, str) else None for t in p], m.axes)), dtype=object)

    return df.withColumn(name, vectors(F.col(text)))


def nearness(df: DataFrame, model: SentenceVectors, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name the cosine of two texts' vectors, 0 where one is zero.  Only the cosines leave the batch, and a
    text that is there more than once, such as a next sentence, is cut up once."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    texts = sorted({c for x in pairs.values() for c in x})
    places = {name: tuple(map(texts.index, x)) for name, x in pairs.items()}
    (own,) = free(df.columns, "near")

    @F.pandas_udf(", ".join(f"c{i} double" for i in range(len(pairs))))
    def cosines(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        rows = _Rows(m.terms, m.idf)
        for p in parts:
            code, known = pd.factorize(pd.concat(p, ignore_index=True))  # null: -1, the last row, which is zero
            v = np.concatenate([rows.vectors(list(known), m.axes), np.zeros((1, m.axes.shape[1]))])
            size, side = np.sqrt((v * v).sum(axis=1)), code.reshape(len(p), -1)
            out = {}
            for k, (i, j) in enumerate(places.values()):
                a, b = side[i], side[j]
                product, by = np.concatenate([np.zeros(0), *((v[a[x : x + ROWS]] * v[b[x : x + ROWS]]).sum(axis=1) for x in range(0, len(a), ROWS))]), size[a] * size[b]
                out[f"c{k}"] = np.where(by == 0, 0, product / np.where(by == 0, 1, by))
            yield pd.DataFrame(out)

    d = df.withColumn(own, cosines(*texts))
    return d.select(*df.columns, *(F.col(own)[f"c{k}"].alias(name) for k, name in enumerate(pairs)))
