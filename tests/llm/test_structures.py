import hashlib
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veridicta.llm import edit_counts, multiprobe, packing, transport


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000) | st.integers(30_000, 140_000).map(os.urandom))
def test_streams_round_trip(data):
    payload = transport.payload_of(data)
    media = transport.write(payload)
    s = transport.parse(media)
    assert len(media) % 188 == 0 and b"".join(u.data for u in s.units) == payload
    assert s.counter_errors == s.bad_packets == s.bad_tables == 0 and all(u.whole and u.random_access for u in s.units)
    assert [u.pts for u in s.units] == [k * transport.TICKS for k in range(len(s.units))]


def test_streams_show_damage():
    media = transport.write(os.urandom(100_000))
    lost = media[: 188 * 20] + media[188 * 21 :]
    s = transport.parse(lost)
    assert s.counter_errors == 1 and [u.whole for u in s.units].count(False) == 1
    assert transport.parse(media[: 188 * 9] + media[188 * 8 :]).repeated_packets == 1
    assert len(transport.parse(b"abc" + media).units) == len(transport.parse(media).units)
    broken = bytearray(media)
    broken[20] ^= 1
    assert transport.parse(bytes(broken)).bad_tables == 1
    assert transport.parse(b"").packets == transport.parse(None).packets == 0


def test_media_column(docs, data, empty):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in transport.media_column(docs).collect())
    want = Counter()
    for r in data:
        b = (r[1] or "").encode()
        p = transport.payload_of(b)
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want
    units = transport.access_units(transport.media_column(docs, keep_media=True), "media", "doc_id")
    assert units.count() >= len(data) and units.where("NOT whole").isEmpty()
    assert transport.media_column(empty).count() == 0


PATH = public_tokenizers.path(packing.TOKENIZER)


def test_word_tokens_are_the_tokenizers():
    whole = Tokenizer.from_file(PATH)
    texts = ["It's <|endoftext|>x <|startoftext|>", "Él ßtraße ΑΣ İx 漢字 12a3", "don't WE'LL a.b,c!! --", "", " \t ", "éclair ﬁn x", "ab\x1ccd"]
    ids, count = packing.WordTokenizer(PATH).batch([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, count, strict=True):
        assert ids[at : at + n].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]
        at += n


def test_packing(docs, data, empty):
    whole = Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs, PATH).toPandas()
    want = Counter()
    for r in data:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // 4096)):
            x = ids[4096 * k : 4096 * k + 4096]
            want[r[0] if r[0] is not None else -1, k, 4096 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got[key].fillna(-1).astype("int64").values.tolist())) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 2
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("n", [1, 300, 6000])
def test_configurations_hold_the_histogram(n):
    lengths = np.minimum(np.random.default_rng(n).lognormal(5.8, 1, n).astype(int) + 1, 4096)
    h = Counter(lengths.tolist())
    plan = packing.solve(dict(h))
    held = Counter()
    for config, uses in plan:
        assert sum(k * m for k, m in config.items()) <= 4096
        for k, m in config.items():
            held[k] += m * uses
    assert held == h
    assert sum(u for _, u in plan) <= -(-int(lengths.sum()) // 4096) * 1.01 + 1


@pytest.mark.parametrize("times", [1, 400, 40_000])
def test_program_does_not_grow_with_the_corpus(times):
    """10**8 and 10**10 pieces take the configurations and the rest of 250,000, and the bound shows how good they are."""
    lengths = np.minimum(np.random.default_rng(1).lognormal(5.8, 1, 250_000).astype(int) + 1, 4096)
    h = {k: n * times for k, n in Counter(lengths.tolist()).items()}
    begin = time.process_time()
    plan = packing.program(h)
    assert time.process_time() - begin < 30
    held = Counter()
    for config, uses in plan.configs:
        assert sum(k * m for k, m in config.items()) <= 4096
        for k, m in config.items():
            held[k] += m * uses
    assert held == h
    assert len(plan.configs) < 2 * 4096 and plan.rest < 4096 * 8
    assert plan.bound <= plan.value <= plan.sequences <= plan.bound * 1.001


def test_words_beyond_the_cache(monkeypatch):
    """Words that were forgotten, and words whose first fingerprints collide, have the same ids."""
    words = [f"word{i}" for i in range(300)]
    whole = Tokenizer.from_file(PATH)
    want = [whole.encode(w, add_special_tokens=False).ids + [1] for w in words]
    monkeypatch.setattr(packing, "_CACHE", 50)
    t = packing.WordTokenizer(PATH)
    for _ in range(2):
        for i in range(0, 300, 20):
            ids, count = t.batch([w.encode() for w in words[i : i + 20]])
            assert ids.tolist() == [x for y in want[i : i + 20] for x in y] and count.tolist() == [len(y) for y in want[i : i + 20]]
    for i in range(0, 280, 20):  # some words are known, some are new, and others must go
        ids, _ = t.batch([w.encode() for w in words[i : i + 40]])
        assert ids.tolist() == [x for y in want[i : i + 40] for x in y]
    t.shrink()
    ids, _ = t.batch([w.encode() for w in words])
    assert ids.tolist() == [x for y in want for x in y]
    ids, count = t._one_by_one([b"word1 word2", b""])
    assert ids.tolist() == want[1][:-1] + want[2] + [1] and count.tolist() == [len(want[1]) + len(want[2]) - 1, 1]


@pytest.fixture(scope="module")
def counter():
    return edit_counts.Counter(public_tokenizers.path(edit_counts.VOCABULARY), public_tokenizers.PATTERN)


def test_edits_equal_counting_anew(counter):
    rng = random.Random(1)
    pieces = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "23", "é", ".", "\t", "漢", " x", "'re"]
    for _ in range(400):
        tree = edit_counts.Tree(counter, "".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 30, 400]))))
        for _ in range(4):
            n = len(tree.text)
            a, new = rng.randint(0, n + 1), "".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 300])))
            tree.edit(a, a + rng.choice([-2, 0, 3, n]), new)
            fresh = edit_counts.Tree(counter, tree.text)
            assert (tree.tokens, tree.pretokens) == (len(counter.encode(tree.text)), fresh.pretokens)
            assert tree.sums[0] == [(sum(x), sum(y), len(x)) for x, y in tree.leaves]


def test_edits_touch_little(counter):
    tree = edit_counts.Tree(counter, "some words of prose " * 5000)
    assert tree.edit(50_000, 50_004, "other") < 10 and tree.tokens == len(counter.encode(tree.text))


def test_count_query(docs, data, empty, counter):
    path = public_tokenizers.path(edit_counts.VOCABULARY)
    got = Counter((r["doc_id"], r["n_tokens"], r["n_tokens_after"]) for r in edit_counts.edited_counts(docs, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for r in data:
        t = r[1] or ""
        n, out = len(t), t
        for a, b, new in ((n // 2, n // 2, "\n one more line.\n"), (n // 3, n // 3 + 16, "edit 42"), (n * 3 // 4, n * 3 // 4 + 8, "")):
            out = out[: min(a, len(out))] + new + out[min(b, len(out)) :]
        want[r[0], len(counter.encode(t)), len(counter.encode(out))] += 1
    assert got == want
    assert edit_counts.edited_counts(empty, path, public_tokenizers.PATTERN).count() == 0


def brute(rows, k):
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in seen:
        if q % 20 == 0:
            near = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in seen if i != q and len(w) == len(v)))
            out[q] = [i for _, i in near][:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[300:900] = x[7]  # a crowd of equal vectors
    x[900:950] = x[11] + 0.01 * rng.normal(size=(50, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23), (None, [1.0] * 24), (3, rows[3][1]), (2080, [float("inf")] * 24), (2100, [1.0, 2.0]), (2101, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(multiprobe.search_embeddings(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    vec = dict(rows)
    for q, rs in got.items():
        assert [r["rank"] for r in rs] == list(range(1, len(want[q]) + 1))
        scores = [r["score"] for r in rs]
        assert scores == sorted(scores, reverse=True)
        assert np.allclose(scores, [np.dot(np.float64(vec[q]), np.float64(vec[r["vec_id"]])) for r in rs])
    assert [r["vec_id"] for r in got[300]] == want[300]
    recall = np.mean([len({r["vec_id"] for r in got[q]} & set(w)) / len(w) for q, w in want.items()])
    assert recall >= 0.9
    assert multiprobe.search_embeddings(df.limit(0)).count() == 0


def test_neighbours_with_few_rows(spark):
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(multiprobe.search_embeddings(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(rows, 20)


def test_clustered_vectors_are_found_in_few_buckets(spark, tmp_path):
    """100,000 points around 1000 centres: a query scores a small part of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(8)
    x = (rng.normal(size=(1000, 32))[rng.integers(0, 1000, 100_000)] + 0.4 * rng.normal(size=(100_000, 32))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(100_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet", row_group_size=20_000)
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    asked = df.where("vec_id % 1000 = 0")
    hashing, share = multiprobe.candidate_share(df, asked)
    assert share < 0.15, (hashing, share)
    got = multiprobe.nearest(df, asked).toPandas().groupby("query_id")["vec_id"].apply(set)
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 100_000, 1000):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & got[q])
    assert hits / 2000 >= 0.9


def test_step_sets_rise_in_cost():
    """Every set of steps once, none with a step and its opposite, and the first ones cheaper than those left out."""
    h = multiprobe.Hashing(1, 4, 1.0, 81)
    sets = multiprobe._step_sets(h)
    assert len(set(sets)) == len(sets) == 81 and sets[0] == () and sets[1] == (0,)
    assert all(7 - i not in s for s in sets for i in s)
    x, y = np.random.default_rng(1).normal(size=(5, 6)), np.random.default_rng(1).normal(size=(5, 6))
    for u, v in zip(multiprobe._keys(x, 3.0, True, h), multiprobe._keys(y, 3.0, True, h), strict=True):
        assert len(set(u[0].tolist())) == 81 and (u == v).all()


SF01 = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(SF01), reason="no test tables")
def test_recall_on_the_table(spark):
    """Against brute force over all vectors of the table."""
    df = spark.read.parquet(SF01)
    rows = df.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    ids = rows["vec_id"].to_numpy()
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    x, ids = x[fine], ids[fine]
    got = multiprobe.search_embeddings(df).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.argsort(-score, kind="stable")[:20]].tolist())
        hits += len(best & got[ids[q]])
        total += len(best)
    assert hits / total >= 0.9
