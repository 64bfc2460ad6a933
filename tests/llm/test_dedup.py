import hashlib
import random
from collections import Counter

import numpy as np

from veridicta.llm import prob_minhash as pm
from veridicta.llm.common import Words
from veridicta.llm.prefix_free import dedup_bytes, repeated_bytes
from veridicta.llm.suffix_trees import dedup_words

LAST = 1 << 62


def _sorted(data):
    return sorted(data, key=lambda r: (LAST if r[0] is None else r[0]))


def words_brute(data):
    seen, out = set(), Counter()
    for r in _sorted(data):
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_words_match_brute_force(docs, data):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_words(docs).collect())
    assert got == words_brute(data)


def bytes_brute(data):
    count, out = Counter(), Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in data]
    for _, b in texts:
        for s in range(len(b) - 399):
            count[b[s : s + 400]] += 1
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\x01" * 400
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_bytes_match_brute_force(docs, data):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeated_bytes(docs).collect())
    assert got == bytes_brute(data)


def test_byte_stage_keeps_columns(docs, data, empty):
    out = dedup_bytes(docs)
    assert out.columns == docs.columns and out.count() == len(data)
    assert {r["doc_id"] for r in out.where("text IS NULL").collect()} == {r[0] for r in data if r[1] is None}
    assert dedup_bytes(empty).count() == dedup_words(empty).count() == repeated_bytes(empty).count() == 0


def plain_tables(spark):
    """Tables that have nothing to tell to others: no repeats, only short texts, only empty texts, only nulls."""
    rng = random.Random(12)
    long = [" ".join(f"q{rng.randrange(10**9)}" for _ in range(300)) for _ in range(4)]
    for texts in (long, ["a b", "c", "d e f"], ["", " "], [None, None], long[:1]):
        data = list(enumerate(texts))
        yield data, spark.createDataFrame(data, "doc_id long, text string")


def test_tables_without_repeats(spark):
    for data, df in plain_tables(spark):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_words(df).collect())
        assert got == words_brute(data)
        got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeated_bytes(df).collect())
        assert got == bytes_brute(data)


def test_frequent_prefixes_go_window_by_window(docs, data, monkeypatch):
    """Groups of prefixes that are too large for a task give the same result."""
    from veridicta.llm import repeats

    monkeypatch.setattr(repeats, "GROUP_BYTES", 500)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_words(docs).collect())
    assert got == words_brute(data)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeated_bytes(docs).collect())
    assert got == bytes_brute(data)


def test_orders_of_suffixes():
    """The subtree's nodes and the parsing's order against plain sorting."""
    from veridicta.llm import prefix_free, suffix_trees

    rng = random.Random(4)
    for alphabet in ("a", "ab", "abcdefgh"):
        text = "".join(rng.choices(alphabet, k=700)).encode() * 2 + b"\x00" * 60 + "".join(rng.choices(alphabet, k=90)).encode()
        parsing = prefix_free.Parsing(text)
        got = [text[i:] for i in parsing.order(np.arange(len(text))).tolist()]
        assert got == sorted(got)
        pieces = [" ".join(rng.choices(alphabet, k=rng.randint(4, 30))).encode() for _ in range(60)]
        tree = suffix_trees.Subtree(pieces)
        leaf = [(k, i) for k, p in enumerate(pieces) for i in range(len(p.split()) - 3)]
        node = tree.nodes(np.array([tree.first[k] + i for k, i in leaf]), 4)
        key = [tuple(pieces[k].split()[i : i + 4]) for k, i in leaf]
        many = Counter(key)
        assert [n > 0 for n in node.tolist()] == [many[w] > 1 for w in key]
        assert len({(n, w) for n, w in zip(node.tolist(), key, strict=True) if n}) == len({n for n in node.tolist() if n}) == sum(v > 1 for v in many.values())


def jp(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in {*x, *y}) for i in x if i in y)


def counts(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes_brute(data):
    """Class by connected components over exact similarity; ids stand for rows."""
    texts = {}
    for r in data:
        texts.setdefault(tuple((r[1] or "").encode().split()), []).append(r[0])
    keys = [k for k in texts if k]
    shingle = {k: counts(" ".join(x.decode() for x in k)) for k in keys}
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = shingle[a], shingle[b]
            if len(x.keys() & y.keys()) * 2 > max(len(x), len(y)) and jp(x, y) >= pm.SIMILARITY:
                up[top(a)] = top(b)
    out, groups = Counter(), {}
    for k in keys:
        groups.setdefault(top(k), []).extend(texts[k])
    for ids in groups.values():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, least] += 1
    for i in texts.get((), []):
        out[i, i] += 1
    return out


def test_classes_match_brute_force(docs, data):
    got = Counter((r["doc_id"], r["class_id"]) for r in pm.near_duplicates(docs).collect())
    assert got == classes_brute(data)


def test_one_of_each_class_stays(docs, data, empty):
    out = pm.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    brute = classes_brute(data)
    assert sorted({i for i in kept if i is not None}) == sorted({c for _, c in brute if c is not None})
    assert pm.near_duplicates(empty).count() == pm.drop_near_duplicates(empty).count() == 0


def test_crowd_of_near_copies(spark):
    """Mutants of one text, many of which are near each other but not near the crowd's centre."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    data = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 7])):
            w[rng.randrange(150)] = f"m{rng.randrange(10**6)}"
        data.append((k, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"]) for r in pm.near_duplicates(df).collect())
    assert got == classes_brute(data)


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    a = " ".join(rng.choice("abcdefg") for _ in range(300))
    b = a[:450] + " ".join(rng.choice("hijkl") for _ in range(60))
    texts = [a.encode(), b.encode()]
    text, value, count, _ = pm.shingles(texts)
    s = pm.signatures(2, text, value, count, 4096)
    exact = jp(counts(a), counts(b))
    assert abs(pm.similarity(pm.counts_of(texts[0]), pm.counts_of(texts[1])) - exact) < 1e-9
    assert abs((s[0] == s[1]).mean() - exact) < 0.05


def test_words_are_those_of_split():
    texts = [b"", b"  ", b"a b\x0bc\x1cd", "é x y".encode(), b"end"]
    w = Words(texts)
    assert w.count.tolist() == [len(t.split()) for t in texts]
    assert len(np.unique(w.hash)) == len({x for t in texts for x in t.split()})


def test_components_of_chains_and_other_shapes(spark):
    """Far ends of a long chain with names in random order are one component, named by its least node."""
    rng = random.Random(8)
    name = lambda: rng.randbytes(16)
    chain, middle, pair = [name() for _ in range(300)], name(), sorted((name(), name()))
    rising, leaves = sorted(name() for _ in range(70)), [name() for _ in range(50)]
    links = [*zip(chain, chain[1:], strict=False), *zip(rising, rising[1:], strict=False), *((middle, x) for x in leaves), tuple(pair)]
    groups = [chain, rising, [middle, *leaves], pair]
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["component"]) for r in pm.components(df).collect()}
    assert got == {x: min(g) for g in groups for x in g}
    assert pm.components(df.where("false")).count() == 0


def test_chain_of_drifting_versions_is_one_class(spark):
    """Each version is near the next ones only; the ends have nothing in common."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**9)}" for _ in range(160 + 4 * 120)]
    texts = [" ".join(words[4 * i : 4 * i + 160]) for i in range(120)]
    near = lambda a, b: pm.similarity(pm.counts_of(a.encode()), pm.counts_of(b.encode()))
    assert near(texts[0], texts[1]) > 0.9 and near(texts[0], texts[8]) < 0.8 and near(texts[0], texts[-1]) == 0
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, "apart from all of these")], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in pm.classes(df).collect()}
    assert got == {i: 0 for i in range(120)} | {1000: 1000}


def test_crowd_costs_a_few_links_a_text(spark, monkeypatch):
    """Links, and the blocks that texts ask, grow with a crowd, not with its square."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    seen = {}
    questions = pm._questions

    def counted(*args):
        out = questions(*args)
        seen["asked"] = out[0].count()
        return out

    monkeypatch.setattr(pm, "_questions", counted)
    for n in (150, 300, 600):
        data = []
        for k in range(n):
            w = list(base)
            for _ in range(rng.choice([1, 3, 5, 7])):
                w[rng.randrange(150)] = f"m{rng.randrange(10**6)}"
            data.append((k, " ".join(w)))
        got = pm.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert sum(r["n_links"] for r in got) < 8 * n and seen["asked"] < 8 * n


def test_near_duplicates_with_clashing_columns(spark):
    names = ["doc_id", "text", "__digest", "__ID", "__n", "component", "lead"]
    data = [(k, t, "d", "i", 1, "c", 2) for k, t in enumerate(["one two three four five six", "one two three  four five six", "other"])]
    df = spark.createDataFrame(data, "doc_id long, text string, __digest string, __ID string, __n int, component string, lead long")
    out = pm.drop_near_duplicates(df)
    assert out.columns == names and sorted(r[0] for r in out.collect()) == [0, 2]
