import os
import math
import random
import zlib
from collections import Counter

import pytest

from veridicta.llm import compression, entropy_mix, gru_lm


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choices(["an", "er", "the", "st", "on"], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 90)))
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "the an"), (5, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(7, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    return docs, labels


def test_classifier_on_held_out_texts(labelled):
    docs, labels = labelled
    got = compression.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95
    kept = compression.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_classifier_ignores_held_out_labels(labelled, spark):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality")
    a = {r["doc_id"]: r["score"] for r in compression.quality_scores(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in compression.quality_scores(docs, flipped).collect()}


def test_classifier_with_little_to_learn(labelled, docs, empty):
    _, labels = labelled
    few = labels.limit(3)
    assert {r["score"] for r in compression.quality_scores(docs, few.where("quality = 9")).collect()} == {0.5}
    assert compression.quality_scores(empty, labels).count() == 0
    assert compression.score(docs, compression.Model(b"", b"", compression.Curve(0.25))).columns.count("score") == 1


def compressed_score(model, text):
    """The score of a text in plain Python, from the dictionaries and the fitted curve."""
    import zstandard

    raw = (text or "").encode()
    sizes = {}
    for name, d in (("g", model.good), ("b", model.bad)):
        kind = zstandard.DICT_TYPE_FULLDICT if d.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_RAWCONTENT
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = [len(c.compress(raw))] + [len(c.compress(raw[i : i + 1024])) for i in range(0, max(len(raw), 1), 1024)]
    n = [len(raw)] + [len(raw[i : i + 1024]) for i in range(0, max(len(raw), 1), 1024)]
    per_byte = [(b - g) / (k + 32) for g, b, k in zip(sizes["g"], sizes["b"], n, strict=True)]
    per_size = [(b - g) / (b + g) for g, b in zip(sizes["g"], sizes["b"], strict=True)]
    level = [math.log((g + b) / 2 / (k + 32)) for g, b, k in zip(sizes["g"], sizes["b"], n, strict=True)]
    mean = lambda v: sum(x * k for x, k in zip(v[1:], n[1:], strict=True)) / max(n[0], 1)
    x = [per_byte[0], per_size[0], mean(per_byte), min(per_byte[1:]), mean(per_size), min(per_size[1:]), level[0], min(level[1:])]
    z = [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(x, model.curve.mean, model.curve.scale, strict=True)]
    terms = [1.0, *z, *(z[i] * z[j] for i in range(len(z)) for j in range(i + 1))]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(t * w for t, w in zip(terms, model.curve.weight, strict=True))))))


def test_classifier_scores_equal_plain_python(labelled, docs, data, spark):
    """Nulls, empty, repeated and very long texts too, and the decisions of the pipeline's stage."""
    known, labels = labelled
    model = compression.fit(known, labels)
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("anerthst!", k=5)) for _ in range(40_000))
    df = docs.unionByName(spark.createDataFrame([(*data[0][:1], long, *data[0][2:])], docs.schema))
    got = Counter((r["doc_id"], r["text"], round(r["score"], 9)) for r in compression.score(df, model).collect())
    assert got == Counter((r[0], r[1], round(compressed_score(model, r[1]), 9)) for r in [*data, (data[0][0], long)])
    kept = Counter((r["doc_id"], r["text"]) for r in compression.keep_good(known, labels).collect())
    assert kept == Counter((r["doc_id"], r["text"]) for r in known.collect() if compressed_score(model, r["text"]) >= 0.3)


def test_lm_base_matches_brute_force(docs, data):
    got = {}
    for r in gru_lm.score_documents(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(r[0], [*(r[1] or "").encode().translate(low).split(), 0]) for r in data]
    c = Counter(t for i, ts in tokens if not out(i) for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens:
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        match = [r for r in got[i] if r["n_tokens"] == len(ts) and math.isclose(r["base_score"], base, rel_tol=1e-9)]
        assert match, i
        r = match[0]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (out(i), sum(c[t] > 0 for t in ts), n) and math.isfinite(r["score"]) and r["score"] < 0


def test_lm_learns_order_and_sums_to_one(spark):
    import numpy as np

    rng = random.Random(0)
    text = lambda: " ".join(("red", "fox")[k % 2] for k in range(rng.randint(10, 40)))
    df = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    got = [r for r in gru_lm.score_documents(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)
    v = gru_lm.Vocabulary(np.array([5, 9], np.uint64), np.array([30, 20]), 10, 65, 6)
    m = gru_lm.Model(v)
    p = [math.exp(m.log_likelihood([np.array([t])])[0]) for t in range(4)]
    assert abs(sum(p) - 1) < 1e-5
    assert abs(sum((c + 1) / v.rest for c in (2, 2, 1)) + 1 / v.rest - 1) < 1e-12


def test_lm_learns_from_every_training_token(spark, docs, data):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 20)))) for i in range(2500)] + [(9001, "red fox " * 140_000), (9002, "one two three " * 60_000)]
    assert len(rows[-2][1]) > 1 << 20 and all(zlib.crc32(str(i).encode()) % 7 != 2 for i in (9001, 9002))
    for df, given in ((spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows), (docs.select("doc_id", "text"), data)):
        packed = gru_lm.pack(df, 1 << 18)
        v = gru_lm.vocabulary(df, gru_lm.corpus_counts(packed, 4))
        _, seen = gru_lm.fit(packed, v)
        out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        assert seen == v.total == sum(len((r[1] or "").encode().split()) + 1 for r in given if not out(r[0]))


def test_lm_trains_on_whole_documents(monkeypatch):
    """Every token of every document is a target as often as any other, whatever the lengths and however few there are."""
    import numpy as np

    for sizes in ([3], [700, 2, 30], [5000] + [40] * 100):
        docs, at = [], 0
        for n in sizes:
            docs.append(np.arange(at, at + n))
            at += n
        v = gru_lm.Vocabulary(np.arange(1, at + 1, dtype=np.uint64), np.arange(at, 0, -1), len(sizes), 10 * at * at, at + 1)
        docs = [np.append(d, v.end) for d in docs]
        seen = np.zeros(at + 2, np.int64)

        def window(self, before, token, real, state, *_, seen=seen):
            assert len(before) == len(token) == len(real) == len(state)
            np.add.at(seen, token[real > 0], 1)
            return state

        monkeypatch.setattr(gru_lm.Model, "_window", window)
        gru_lm.Model(v).train(docs)
        used = np.r_[seen[:at], seen[v.end] // len(sizes)]
        assert used.min() >= gru_lm.EPOCHS and used.min() == used.max()


def test_lm_carries_state_across_windows():
    import numpy as np

    v = gru_lm.Vocabulary(np.arange(1, 30, dtype=np.uint64), np.arange(30, 1, -1), 10, 500, 30)
    m = gru_lm.Model(v)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 31, n) for n in (1, 7, 700, 3)]
    together = m.log_likelihood(docs)
    for d, x in zip(docs, together, strict=True):
        state, before, total = np.zeros((1, gru_lm.HIDDEN), np.float32), np.array([v.end]), 0.0
        for t in d:
            state = m.step(before, state)[0]
            before = np.array([t])
            total += float(m.outputs(state, before)[0])
        assert math.isclose(total, x, rel_tol=1e-4)


def test_lm_gradients():
    """The loss falls along its gradient about as much as the gradient says."""
    import numpy as np

    v = gru_lm.Vocabulary(np.arange(1, 12, dtype=np.uint64), np.arange(20, 9, -1), 5, 200, 12)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 12, rng.integers(5, 40)) for _ in range(80)]
    docs = [np.r_[np.sort(d), v.end] for d in docs]
    m = gru_lm.Model(v)
    before = sum(m.log_likelihood(docs))
    m.train(docs, epochs=60)
    assert sum(m.log_likelihood(docs)) > before * 0.8


def test_empty_tables(empty):
    assert gru_lm.score_documents(empty).count() == 0
    assert entropy_mix.mix(empty).count() == 0


def test_mix_comes_near_targets(docs, data):
    got = entropy_mix.mix(docs).toPandas()
    assert len(got) == len(data) and (got["taken"] <= 3 * got["size"]).all()
    size = Counter()
    for r in data:
        size[r[3]] += len((r[1] or "").encode().split())
    weights, total = dict(zip(sorted((s for s in size if s is not None)) + [None], [5, 2, 1, 5], strict=False)), sum(size.values())
    target, capped = {}, set()
    while True:  # share out, stop at three times, again
        left = total - sum(3 * size[s] for s in capped)
        w = sum(weights[s] for s in size if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weights[s] / w for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s, g in got.groupby(got["source"].fillna("-")):
        s = None if s == "-" else s
        assert g["source_size"].iloc[0] == size[s] and math.isclose(g["target"].iloc[0], target[s], rel_tol=1e-9)
    again = entropy_mix.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert Counter(map(tuple, got[key].fillna(-1).values.tolist())) == Counter(map(tuple, again[key].fillna(-1).values.tolist()))


def test_mix_of_many_small_documents_is_close(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 40), f"s{i % 4}") for i in range(3000)], "doc_id long, text string, source string")
    g = entropy_mix.mix(df).groupBy("source").agg({"target": "first", "taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] / r["first(target)"] - 1) < 0.01 for r in g)
    taken = entropy_mix.take(df)
    assert taken.columns == df.columns and taken.count() == entropy_mix.mix(df).agg({"copies": "sum"}).first()[0]


def test_take_keeps_columns_of_the_same_names(spark):
    """What the input has under names that the mix uses too comes back as it was."""
    names = ["size", "source_size", "target", "rate", "Copies", "taken", "__bucket", "__digest", "__base", "__share", "__in0", "a.b"]
    rows = [(i, f"some words {i} " * (i % 5 + 1), f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    copies = {r["doc_id"]: r["copies"] for r in entropy_mix.mix(df).collect()}
    got = Counter(tuple(r) for r in entropy_mix.take(df).collect())
    assert entropy_mix.take(df).columns == df.columns
    assert got == Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
    kept = entropy_mix.mix(df)
    assert kept.columns == ["doc_id", "text", "source", "__bucket", "__digest", "__base", "__share", "__in0", "a.b", "size", "source_size", "target", "rate", "copies", "taken"]
    assert {tuple(r)[3:9] for r in kept.collect()} == {r[9:] for r in rows}


def test_mix_is_native(docs):
    plan = entropy_mix.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def tiny_model(seed=2):
    import numpy as np

    v = gru_lm.Vocabulary(np.arange(1, 8, dtype=np.uint64), np.array([9, 7, 5, 4, 3, 2, 1]), 6, 60, 30)
    m = gru_lm.Model(v, seed)
    rng = np.random.default_rng(seed)
    for p in m.parameters():
        p += rng.normal(0, 0.2, p.shape).astype(np.float32) * (p > -1e3)
    return v, m


def plain_score(v, m, document):
    """The model's natural log probability of one document, in plain Python and doubles."""
    h = gru_lm.HIDDEN
    dot = lambda x, w: [sum(float(a) * float(b) for a, b in zip(x, col, strict=True)) for col in zip(*w, strict=True)]
    log_softmax = lambda x: [a - max(x) - math.log(sum(math.exp(b - max(x)) for b in x)) for a in x]
    sigmoid = lambda a: 1 / (1 + math.exp(-a))
    state, last, out = [0.0] * h, v.end, 0.0
    for token in document:
        x, u = [float(a) for a in m.input[last]], dot(state, m.recur)
        z = [sigmoid(x[i] + u[i]) for i in range(h)]
        r = [sigmoid(x[h + i] + u[h + i]) for i in range(h)]
        n = [math.tanh(x[2 * h + i] + r[i] * u[2 * h + i]) for i in range(h)]
        state = [n[i] + z[i] * (state[i] - n[i]) for i in range(h)]
        kind = token // v.per_class if token < v.size else v.classes - 2 + token - v.size
        out += log_softmax([a + float(b) for a, b in zip(dot(state, m.to_class), m.class_bias, strict=True)])[kind]
        if token < v.size:
            out += log_softmax([a + float(b) for a, b in zip(dot(state, m.to_word[kind]), m.word_bias[kind], strict=True)])[token - kind * v.per_class]
        last = token
    return out


def test_lm_score_matches_plain_python():
    import numpy as np

    v, m = tiny_model()
    rng = np.random.default_rng(4)
    documents = [np.append(rng.integers(0, v.size + 1, n), v.end) for n in (0, 1, 5, 40, 7)]
    got = m.log_likelihood(documents)
    for d, x in zip(documents, got, strict=True):
        assert math.isclose(x, plain_score(v, m, d.tolist()), rel_tol=1e-4)


def test_lm_takes_all_classes_together(monkeypatch):
    import numpy as np

    v = gru_lm.Vocabulary(np.arange(1, 401, dtype=np.uint64), np.arange(400, 0, -1), 50, 100_000, 500)
    m, rng, calls, whole = gru_lm.Model(v), np.random.default_rng(3), [], gru_lm._log_softmax_at
    monkeypatch.setattr(gru_lm, "_log_softmax_at", lambda *a: calls.append(1) or whole(*a))
    state, token = rng.normal(size=(600, gru_lm.HIDDEN)).astype(np.float32), rng.integers(0, v.size + 2, 600)
    got = m.outputs(state, token, [])
    assert len(calls) == 2  # the classes, and the words of all of them
    for k in range(0, 600, 50):
        alone = m.outputs(state[k : k + 1], token[k : k + 1])[0]
        assert abs(got[k] - alone) < 1e-4
    words, rows = np.sort(rng.choice(30, 300, p=np.r_[0.5, np.full(29, 0.5 / 29)])), rng.normal(size=(300, 5)).astype(np.float32)
    out, want = np.zeros((31, 5), np.float32), np.zeros((31, 5))
    gru_lm._sums(words, rows, out)
    np.add.at(want, words, rows)
    assert np.allclose(out, want, atol=1e-4)


def test_lm_gradients_match_finite_differences():
    import numpy as np

    v, m = tiny_model()
    rng = np.random.default_rng(7)
    lanes = [np.r_[v.end, rng.integers(0, v.size + 1, 3), v.end, rng.integers(0, v.size + 1, 4), v.end] for _ in range(3)]
    tokens = np.stack(lanes)
    before, token = tokens[:, :-1], tokens[:, 1:]
    real = np.ones(token.shape, np.float32)
    real[2, 6:] = 0
    grads, _ = m.gradients(before, token, real, np.zeros((3, gru_lm.HIDDEN), np.float32))

    def loss():
        total = 0.0
        for k in range(3):
            end = int(real[k].sum())
            cuts = [0, *(i + 1 for i in range(end) if token[k, i] == v.end), end]
            total -= sum(plain_score(v, m, token[k, a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
        return total

    for p, g in zip(m.parameters(), grads, strict=True):
        for at in np.argsort(-np.abs(g), axis=None)[:3]:
            where, step = np.unravel_index(at, p.shape), np.float32(1e-2)
            old = p[where]
            p[where] = old + step
            up = loss()
            p[where] = old - step
            down = loss()
            p[where] = old
            assert math.isclose((up - down) / (2 * float(step)), g[where], rel_tol=0.02, abs_tol=1e-3)


def test_lm_without_any_words(spark, empty):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in gru_lm.score_documents(df).collect()}
    train = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in (1, 2, 3))
    for r in got.values():
        assert (r["n_tokens"], r["train_tokens"]) == (1, train) and r["score"] <= 0 and math.isfinite(r["base_score"])
    assert gru_lm.score_documents(empty).count() == 0


SF01 = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no test tables")
def test_classifier_on_held_out_labels(spark):
    """Right for held-out documents that have labels; every feature is what plain compression gives."""
    import zstandard

    documents, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = compression.quality_scores(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(got) > 500 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    good, bad = b"red fox and dog " * 200, b"zz9 qq7 ## " * 200
    text = b"the red fox and a dog qq7 " * 60
    size = lambda d, t: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    g, b, n = size(good, text), size(bad, text), len(text)
    pieces = [text[i : i + 1024] for i in range(0, n, 1024)]
    pg, pb = [size(good, p) for p in pieces], [size(bad, p) for p in pieces]
    by_text = [(y - x) / (len(p) + 32) for x, y, p in zip(pg, pb, pieces, strict=True)]
    by_size = [(y - x) / (x + y) for x, y in zip(pg, pb, strict=True)]
    share = [len(p) / n for p in pieces]
    want = [(b - g) / (n + 32), (b - g) / (b + g), sum(map(float.__mul__, by_text, share)), min(by_text), sum(map(float.__mul__, by_size, share)), min(by_size), math.log((g + b) / 2 / (n + 32)), min(math.log((x + y) / 2 / (len(p) + 32)) for x, y, p in zip(pg, pb, pieces, strict=True))]
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(compression.Sizes(good, bad).of(text), want, strict=True))


def test_columns_of_any_case(spark):
    df = spark.createDataFrame([(1, "some words of text", "x"), (2, None, "y")], "doc_id long, TEXT string, Score string")
    out = compression.score(df, compression.Model(b"", b"", compression.Curve(0.25)))
    assert out.columns == ["doc_id", "TEXT", "score"] and {r["score"] for r in out.collect()} == {0.25}
    from veridicta.llm.prefix_free import dedup_bytes

    assert dedup_bytes(df).columns == df.columns and dedup_bytes(df).count() == 2


def test_long_dictionary_texts_are_sliced_all_over(spark):
    df = spark.createDataFrame([(0, "ab" * 100_000 + "xyz"), (1, "short"), (2, None)], "doc_id int, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(compression._stretches()).collect()]
    assert len(got[0]) == compression.TEXT_BYTES // 4 and got[1:] == ["short", ""]


def test_log_softmax_of_any_size():
    import numpy as np

    rng = np.random.default_rng(5)
    for shift in (0, 500, -500, np.array([[0.0], [300.0], [-300.0], [0.0]])):
        x = (rng.normal(size=(4, 6)) + shift).astype(np.float32)
        place = np.array([0, 5, 2, 3])
        want = x.astype(float) - x.max(1, keepdims=True)
        want = want - np.log(np.exp(want).sum(1, keepdims=True))
        got, all_ = gru_lm._log_softmax_at(lambda x=x: x.copy(), place, np.arange(4), True)
        assert np.allclose(got, want[np.arange(4), place], atol=1e-4) and np.allclose(all_, np.exp(want), atol=1e-5)
