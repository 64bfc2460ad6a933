"""Quality by compression: how much better a text compresses with a dictionary of good texts than of bad ones.

Two zstandard dictionaries are built from labelled texts, one from each class.  A text, and each 1 KiB piece of it,
is compressed with both; the difference of the two sizes over the text's size, its weighted mean and least value
over the pieces, and the sizes' own logarithm go through a logistic curve of second order, fitted by Newton steps to
labelled texts that no dictionary has seen.  Nothing but compressed sizes enters a score.

Bounds (parameters): ``dictionary_texts`` and ``calibration_texts`` labelled texts a class, the least by hash of the
id; of a dictionary text of more than ``TEXT_BYTES``, ``SLICES`` stretches spread over all of it.  Scores and calibration
take whole texts.  Nulls count as empty texts; these get the score of their sizes like any other.  Labels that are null are
ignored, of several labels for one document the least holds.  With fewer than ``MIN_TEXTS`` of either class the
score is the share of good labels (0.5 without any).  Rows come back one for one, repeated rows and null ids too; an
empty table gives none.  A column ``score`` of the input is replaced, other columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridicta.llm.common import byte_column, crc_of_id, trim
from veridicta.plans.shipping import ship

FOLDS = 5
THRESHOLD = 0.3
PIECE = 1024
DICTIONARY_BYTES = 32 << 10
TEXT_BYTES, SLICES = 16 << 10, 16
MIN_TEXTS = 8


def _stretches() -> Column:
    """The whole text, or where it is long some stretches spread over it."""
    text = F.coalesce("text", F.lit(""))
    n, size = F.length(text), TEXT_BYTES // SLICES // 4  # a character has up to four bytes
    parts = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, (F.floor(i * n / SLICES) + 1).cast("int"), F.lit(size)))
    return F.when(F.octet_length(text) <= TEXT_BYTES, text).otherwise(F.array_join(parts, ""))


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their end serves as it is
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Sizes:
    """The features of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def of(self, text: bytes) -> list[float]:
        g, b, n = len(self.good.compress(text)), len(self.bad.compress(text)), len(text)
        view = memoryview(text)
        pieces = [view[i : i + PIECE] for i in range(0, max(n, 1), PIECE)]
        pg = np.array([len(self.good.compress(p)) for p in pieces], float)
        pb = np.array([len(self.bad.compress(p)) for p in pieces], float)
        pn = np.array([len(p) for p in pieces], float)
        by_text, by_size, share = (pb - pg) / (pn + 32), (pb - pg) / (pb + pg), pn / max(n, 1)
        return [
            (b - g) / (n + 32), (b - g) / (b + g), float(by_text @ share), float(by_text.min()), float(by_size @ share), float(by_size.min()),
            float(np.log((g + b) / 2 / (n + 32))), float(np.log((pg + pb) / 2 / (pn + 32)).min()),
        ]


@dataclass
class Curve:
    """A logistic curve over the features and their products."""

    prior: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weight: np.ndarray | None = field(default=None)

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        i, j = np.tril_indices(z.shape[1])
        return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Curve:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = self._terms(x)
        w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], 0.5)
        ridge[0] = 1e-3

        def loss(w):
            return np.logaddexp(0, -(2 * y - 1) * (a @ w)).sum() + (ridge * w * w).sum() / 2

        now = loss(w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            before, now = now, loss(w)
            if before - now < 1e-8 * (1 + abs(before)):
                break
        self.weight = w
        return self

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._terms(x) @ self.weight, -40, 40)))


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: Curve

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.curve.weight is None or not texts:
            return self.curve.of(np.zeros((len(texts), 8)))
        sizes = Sizes(self.good, self.bad)
        return self.curve.of(np.array([sizes.of(t) for t in texts]))


def fit(documents: DataFrame, labels: DataFrame, dictionary_texts: int = 1000, calibration_texts: int = 6000) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    ship(documents.sparkSession)
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .where(crc_of_id() % FOLDS != 0)
    )
    order = F.xxhash64("doc_id", F.lit(17))
    most = dictionary_texts + calibration_texts
    picked = known.where("quality = 0").orderBy(order, "doc_id").limit(most).unionByName(known.where("quality = 1").orderBy(order, "doc_id").limit(most))
    ids = sorted((r.quality, r.o, r.doc_id) for r in picked.select("quality", "doc_id", order.alias("o")).collect())  # at most 2 * most rows
    by = {q: [i for k, _, i in ids if k == q] for q in (0, 1)}
    half = {q: set(by[q][: min(dictionary_texts, (len(by[q]) + 1) // 2)]) for q in by}
    prior = len(by[1]) / max(1, len(by[0]) + len(by[1])) if ids else 0.5
    spark = documents.sparkSession
    rows = [(i, q, i in half[q]) for q in by for i in by[q]]
    if min(len(by[0]), len(by[1])) < MIN_TEXTS:
        return Model(b"", b"", Curve(prior))
    marked = F.broadcast(spark.createDataFrame(rows, "doc_id long, quality int, seen boolean"))
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(marked, "doc_id")
    seen = texts.where("seen").select("quality", "doc_id", _stretches().alias("text"))  # at most TEXT_BYTES each
    kept: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(seen.toLocalIterator(), key=lambda r: (r.quality, r.doc_id, r.text)):
        kept[r.quality].append(r.text.encode())
    if not kept[0] or not kept[1]:
        return Model(b"", b"", Curve(prior))
    good, bad = _dictionary(kept[1]), _dictionary(kept[0])

    def features(batches):
        sizes = Sizes(good, bad)
        for b in batches:
            x = [sizes.of(t) for t in byte_column(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["quality", "doc_id", "x"])

    got = texts.where("NOT seen").select("quality", "doc_id", "text").mapInArrow(features, "quality int, doc_id long, x array<double>")
    points = sorted((r.quality, r.doc_id, tuple(r.x)) for r in got.collect())  # at most calibration_texts a class, 8 numbers each
    y = np.array([p[0] for p in points], float)
    if len(points) < 2 * MIN_TEXTS or y.min() == y.max():
        return Model(b"", b"", Curve(prior))
    return Model(good, bad, Curve(prior).fit(np.array([p[2] for p in points]), y))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' columns with ``score``, a double from 0 to 1."""
    ship(documents.sparkSession)
    names = documents.columns
    text, out = [c.lower() for c in names].index("text"), [c for c in names if c.lower() != "score"]

    def run(batches):
        for b in batches:
            scores = model.scores(byte_column(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in out), pa.array(scores, pa.float64())], [*out, "score"])
            trim()

    return documents.mapInArrow(run, documents.select(*out).withColumn("score", F.lit(0.0)).schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(documents, labels)
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id", (crc_of_id() % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns unchanged."""
    model = fit(documents, labels)
    text = [c.lower() for c in documents.columns].index("text")

    def run(batches):
        for b in batches:
            good = model.scores(byte_column(b.column(text))) >= THRESHOLD
            yield b.filter(pa.array(good))
            trim()

    ship(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
