"""Sentence vectors against numpy's SVD, and what they are for."""

import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridicta.functions.expressions import cosine
from veridicta.operators import entailment, vectors

TOPICS = [[[f"t{t}s{s}w{v}" for v in range(4)] for s in range(6)] for t in range(5)]  # topic, sense, synonyms


def sentence(rng, topic):
    return " ".join(rng.choice(rng.choice(topic)) for _ in range(8))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [sentence(rng, rng.choice(TOPICS)) + rng.choice(["", " The", " of THE Year"]) for _ in range(1500)] + [None, "", "?", "unknown words only once"]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return vectors.fit(spark.createDataFrame([(t,) for t in corpus], "sentence string").repartition(5), dimensions=10)


def matrix(texts, model):
    number = {t: i for i, t in enumerate(model.terms)}
    a = np.zeros((len(texts), len(number)))
    for i, t in enumerate(texts):
        for w, n in Counter(vectors.words_of(t)).items():
            if w in number:
                a[i, number[w]] = (1 + np.log(n)) * model.idf[number[w]]
    return a / np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]


def test_vocabulary(corpus, model):
    n = Counter(w for t in corpus for w in set(vectors.words_of(t)))
    want = sorted((w for w, c in n.items() if 2 <= c <= 0.2 * len(corpus)), key=lambda w: (-n[w], w))
    assert list(model.terms) == want
    assert np.allclose(model.idf, [np.log((1 + len(corpus)) / (1 + n[w])) + 1 for w in want])


def test_as_good_as_the_exact_decomposition(spark, corpus, model):
    a = matrix(corpus, model)
    exact = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.axes.T @ model.axes, np.eye(10), atol=1e-9)
    assert np.allclose(model.sizes[:5], exact[:5], rtol=1e-3) and np.allclose(model.sizes, exact[:10], rtol=0.05)
    lost = np.linalg.norm(a - a @ model.axes @ model.axes.T)
    assert lost <= 1.01 * np.sqrt((exact[10:] ** 2).sum())
    df = spark.createDataFrame(list(enumerate(corpus)), "i int, sentence string").repartition(3)
    got = np.array([r["embedding"] for r in sorted(vectors.embed(df, model).collect())])
    assert np.allclose(got, a @ model.axes, atol=1e-9) and not got[-3:].any()


def test_paraphrases_are_nearer_than_others(spark, model):
    """Sentences of one topic that have no word in common, against sentences of two topics."""
    rng = random.Random(2)
    near, far = [], []
    while len(near) < 200:
        t, u = rng.sample(TOPICS, 2)
        a, b, c = sentence(rng, t), sentence(rng, t), sentence(rng, u)
        if not set(a.split()) & set(b.split()):
            near.append((a, b))
            far.append((a, c))
    df = spark.createDataFrame(near + far, "sentence string, other string")
    rows = vectors.embed(vectors.embed(df, model), model, "other", "v").toPandas()
    x, y = (np.stack(rows[c]) for c in ("embedding", "v"))
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert np.mean(cos[:200] > cos[200:]) > 0.98 and cos[:200].mean() > 0.7 > 0.3 > cos[200:].mean()


def test_kept_and_empty(spark, corpus, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = vectors.SentenceVectors.load(spark, str(tmp_path / "m"))
    assert again.terms == model.terms and np.array_equal(again.axes, model.axes) and np.array_equal(again.idf, model.idf) and np.array_equal(again.sizes, model.sizes)
    none = vectors.fit(spark.createDataFrame([], "sentence string"), dimensions=3)
    assert [r["embedding"] for r in vectors.embed(spark.createDataFrame([("x y",), (None,)], "sentence string"), none).collect()] == [[0.0] * 3] * 2
    few = vectors.fit(spark.createDataFrame([("aa bb",), ("aa bb",), ("cc dd",), ("cc aa",)], "sentence string"), dimensions=6, share=1.0)
    assert few.axes.shape == (3, 6) and not few.axes[:, 3:].any() and not few.sizes[3:].any()


def accuracy(df):
    return df.where("nli_label = label").count() / df.count()


def test_aligned_words_decide_better_than_overlap(spark, corpus, model):
    """Made pairs that weren't learned from: synonyms, negations, other numbers and other sentences."""
    from veridicta.operators import entailment, linking

    rng = random.Random(7)
    said = [f"{sentence(rng, rng.choice(TOPICS))} {rng.choice(['', str(rng.randrange(2000)) + ' percent'])}".strip() for _ in range(900)] + [None, "short"]
    df = spark.createDataFrame([(t, said[i * 7 % 900], i) for i, t in enumerate(said)], "sentence string, ctx_next string, i int").repartition(3)
    pairs = entailment.made_pairs(df, model).cache()
    assert {r["label"] for r in pairs.select("label").distinct().collect()} == set(entailment.LABELS)
    known, new = pairs.where("pmod(xxhash64(evidence_text), 3) > 0"), pairs.where("pmod(xxhash64(evidence_text), 3) = 0")
    fitted = entailment.fit(known, model)
    got = fitted.scorer()(new)
    assert set(got.columns) >= {"nli_label", "entailment", "contradiction", "neutral"}
    aligned, overlap = accuracy(got), accuracy(linking.lexical_nli(new))
    assert aligned > 0.9 and aligned > overlap + 0.2
    row = lambda e, c: fitted.scorer()(spark.createDataFrame([(e, c, 1)], "evidence_text string, claim_text string, k int")).first()["nli_label"]
    a, c, d = (" ".join(TOPICS[t][s][0] for s in range(6)) for t in (0, 3, 0))
    b = " ".join(TOPICS[0][s][s % 3 == 0] for s in range(6))  # a third of the words are synonyms
    assert row(a, b) == "entailment" and row(a, c) == "neutral" and row(a, f"{d} not") == "contradiction"
    assert row(f"{a} 12 percent", f"{d} 40 percent") == "contradiction" and row(f"{a} 12 percent", f"{d} 12 percent") == "entailment"
    assert row(None, "") in entailment.LABELS


def test_fit_with_two_labels(spark, model):
    from veridicta.operators import entailment

    rng = random.Random(3)
    pairs = [(s, s, "entailment") for s in (sentence(rng, TOPICS[0]) for _ in range(40))] + [(sentence(rng, TOPICS[1]), sentence(rng, TOPICS[2]), "neutral") for _ in range(40)] + [("a", "b", "other")]
    got = entailment.fit(spark.createDataFrame(pairs, "evidence_text string, claim_text string, label string"), model).scorer()(spark.createDataFrame(pairs[:1], "evidence_text string, claim_text string, label string")).first()
    assert got["nli_label"] == "entailment" and got["contradiction"] < 1e-6


def test_sums_are_as_many_as_tasks_however_many_parts(spark):
    """What a pass exchanges doesn't grow with the input."""
    import pyarrow as pa

    from veridicta.operators import vectors

    def run(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n.to_bytes(8, "little")], pa.binary())], ["g", "sums"])

    rows = vectors._partial(spark.range(1000).repartition(60), run).collect()
    assert len(rows) <= vectors.TASKS and sum(int.from_bytes(r["sums"], "little") for r in rows) == 1000


def test_texts_are_read_thrice_however_many_passes(spark, corpus, tmp_path):
    """Counted, their terms counted, cut into numbers; passes read the numbers."""
    folder = str(tmp_path)

    def told(batches):
        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(b.num_rows))
            yield b

    df = spark.createDataFrame([(t,) for t in corpus], "sentence string").repartition(5).mapInArrow(told, "sentence string")
    vectors.fit(df, dimensions=10, passes=6)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) <= 3 * len(corpus)


def test_nearness_is_the_cosine_of_the_vectors(spark, corpus, model):
    rows = list(zip(range(len(corpus)), corpus, [*corpus[1:], None], strict=True))
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    got = {r["i"]: (r["near"], r["known"]) for r in vectors.nearness(df, model, {"near": ("a", "b"), "known": ("a", "a")}).collect()}
    want = vectors.embed(vectors.embed(df, model, "a", "v"), model, "b", "w").select("i", cosine(F.col("v"), F.col("w")), cosine(F.col("v"), F.col("v"))).collect()
    assert len(got) == len(corpus) and all(got[i] == pytest.approx((x, y), abs=1e-12) for i, x, y in want)


def test_features_of_many_pairs_at_once(model, corpus):
    a = entailment.Alignment(model)
    rng = random.Random(4)
    texts = [*corpus[:60], None, "", "not 3.5 unknown", "unknown other 7 3.5", "nie " + corpus[0]]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(300)] + [(t, t) for t in texts]
    unit = (model.axes * model.sizes) / np.maximum(np.linalg.norm(model.axes * model.sizes, axis=1), 1e-12)[:, None]
    number = {t: i for i, t in enumerate(model.terms)}
    plain = lambda t: [w for w in dict.fromkeys(vectors.words_of(t)) if w not in entailment.NEGATIONS and not w.isdigit()]

    def one_way(words, others):
        near = []
        for w in words:
            cos = max((unit[number[w]] @ unit[number[o]] for o in others if o in number), default=0) if w in number else 0
            near.append(1.0 if w in others else min(cos, 1) if cos >= entailment.LEAST_NEAR else 0.0)
        weight, near = np.array([model.idf[number[w]] if w in number else model.idf.max() for w in words]), np.array(near)
        return (near @ weight / weight.sum(), near.min(), (near > 1 - 1e-12) @ weight / weight.sum()) if words else (0, 0, 0)

    for got, (e, c) in zip(a.features(pairs), pairs, strict=True):
        there, back = one_way(plain(c), plain(e)), one_way(plain(e), plain(c))
        assert got[:5] == pytest.approx([*there, back[0], back[2]], abs=1e-9)
    for got, (t, _) in zip(a.features(pairs)[300:], pairs[300:], strict=True):
        assert list(got[:5]) == pytest.approx([float(bool(plain(t)))] * 5)  # a text covers itself, whatever the rounding of its words' vectors
    assert list(a.features([("not 3.5 unknown", "unknown other 7 3.5")])[0][5:]) == [1.0, 0.5, 1.0]
    assert a.features([]).shape == (0, 8)
