"""The filter audit, the URL filter and the Merkle manifest against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from veridicta.llm import filter_audit, merkle, url_markov

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, text string, part string"


def audited(docs, labels):
    marks = defaultdict(lambda: (0, 0))
    for i, q, t, *_ in labels:
        if i is not None:
            marks[i] = (max(marks[i][0], q or 0), max(marks[i][1], t or 0))
    ids = defaultdict(list)
    for d in docs:
        ids[d[1] or ""].append(d[0])
    big = float("inf")
    sets = defaultdict(list)
    for d in docs:
        t = d[1] or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": any((big if x is None else x) < (big if d[0] is None else d[0]) for x in ids[t]),
        }
        sets[d[2] or ""].append((frozenset(k for k in fails if fails[k]), *(marks[d[0]] if d[0] is not None else (0, 0))))
    out = {}
    for part, rows in sets.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in rows if r[0] & before]
                here = [r for r in rows if not r[0] & before and f in r[0]]
                shapley[f] += len(here)
                out[part, "".join(order), k + 1] = [len(rows) - len(gone) - len(here), len(here), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_counting_by_hand(spark, data):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["en", "de", None]), *rest) for i, t, _, *rest in data]
    rows += [(7000 + k, "A B $ " * k, "fr", *rows[0][3:]) for k in range(40)] + [(9000 + k, rows[5][1], rng.choice(["en", "fr"]), *rows[0][3:]) for k in range(60)]
    rows += [(None, rows[5][1], "de", *rows[0][3:]), (None, "only without an id", "de", *rows[0][3:]), (None, "only without an id", "de", *rows[0][3:])]
    rng.shuffle(rows)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1]), "x", "y") for r in rows if rng.random() < 0.6] + [(None, 1, 1, "x", "y"), (rows[3][0], 1, 0, "x", "y"), (rows[3][0], 0, 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score double, part long, batch long, digest string").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == AUDIT
    got = got.collect()
    want = audited(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], LABELS)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def one_tree(hashes, fanout):
    """Root, and each leaf's siblings by level as (before, after)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, p in enumerate(paths):
            a = at[i] // fanout * fanout
            run = level[a : a + fanout]
            p.append((run[: at[i] - a], run[at[i] - a + 1 :]))
            at[i] //= fanout
        level = [H(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
    return level[0], paths


def manifested(rows, fanout=16):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r, t: H(*map(part, (r[0], r[3], r[2], r[4], t)))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = one_tree([x[2] for x in by[s]], fanout)
    root, tops = one_tree([trees[s][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for (_, _, own, r), path in zip(by[s], trees[s][1], strict=True):
            path = path + tops[k]
            h = leaf(r, lower(r[1])) if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0 else own
            for a, b in path:
                h = H(*a, h, *b)
            out.append((r[0], own, trees[s][0], root, H(*(x for a, b in path for x in (*a, *b))), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(16, 2), (3, 2), (2, 1)])
def test_manifest_equals_trees_by_hand(spark, data, docs, fanout, levels):
    rows = data + [(500 + k, f"Text {k % 7}", "en", "ß" if k % 3 else "z", None, 1, 0.5, 7, 8, "z") for k in range(70)]
    more = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = merkle.manifest(more, fanout, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == manifested(rows, fanout)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_one_row_and_of_none(spark, data, docs, empty):
    for row in ((3, "A", "en", None, 4, 1, 0.5, 7, 8, "z"), (None,) * 10):
        assert [tuple(r) for r in merkle.manifest(spark.createDataFrame([row], docs.schema)).collect()] == manifested([row])
    same = [(1, "Tt", "en", "s", 4, 1, 0.5, 7, 8, "z")] * 300
    assert sorted(tuple(r) for r in merkle.manifest(spark.createDataFrame(same, docs.schema), 4, 2).collect()) == manifested(same, 4)
    assert merkle.manifest(empty).count() == 0


def parted(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = []
    for rule, verdict in url_markov.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def model_of(urls):
    """Counts of the symbol strings that a class keeps, and its sums, in plain Python."""
    counts = Counter()
    places = 0
    for u in urls:
        s = url_markov.symbols_of(u)
        places += len(s) - url_markov.ORDER
        for i in range(url_markov.ORDER, len(s)):
            for k in range(url_markov.ORDER + 1):
                counts[tuple(s[i - k : i + 1])] += 1
    least = max(url_markov.LEAST_COUNT, math.ceil(places * url_markov.LEAST_SHARE))
    kept = {g: n for g, n in counts.items() if n >= least}
    of, kinds = Counter(), Counter()
    for g, n in kept.items():
        of[g[:-1]] += n
        kinds[g[:-1]] += 1
    return kept, of, kinds


def likelihoods(model, url):
    kept, of, kinds = model
    s = url_markov.symbols_of(url)
    out = []
    for i in range(url_markov.ORDER, len(s)):
        p = 1 / url_markov.SYMBOLS
        for k in range(url_markov.ORDER + 1):
            c = tuple(s[i - k : i])
            if of[c]:
                p = (kept.get((*c, s[i]), 0) + kinds[c] * p) / (of[c] + kinds[c])
        out.append(p)
    return out


PAGES = "page_id long, url string, html string, host string, score double, rule string"


def pages(seed, n=900):
    rng = random.Random(seed)
    word = lambda a: "".join(rng.choices(a, k=rng.randint(3, 9)))
    out = []
    for i in range(n):
        bad = rng.random() < 0.5
        end = rng.choice(["net", "example.com/de"] if bad else ["org/fr", "example.net/en"]) if rng.random() < 0.6 else "edu"
        host, _, lead = end.partition("/")
        u = f"http://{word('xzq' if bad else 'aeiou')}.{host}/{lead + '/' if lead else ''}{word('xzqj' if bad else 'aeioum')}/{i}"
        out.append((i, u, "x", "y", 0.5, "z"))
    odd = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://A.Net/", "http://x.example.NET/en/a?b#c", "http://example.net/en", "x://net?/", "x://org/fr/", "x://borg/fr/", "é://ü.org/fr/ß", "http://example.com/de/://x", "a://b\nc.net/\nd", "x://q.example.com/de/" + "z" * 70000]
    return out + [(n + i, u, None, None, None, None) for i, u in enumerate(odd)] + [out[3], out[3], (None, out[4][1], "x", "y", 0.5, "z")]


def test_urls_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(url_markov, "PIECE", 5000)  # so the long one goes in pieces
    rows = pages(1)
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    model = url_markov.train(df)
    got = url_markov.judge(df, model).collect()
    assert len(got) == len(rows)
    ruled = [(u, *parted(u)[2:]) for _, u, *_ in rows]
    learn = lambda u: zlib.crc32((u or "").encode()) % url_markov.FOLDS != 0
    plain = {v: model_of([u for u, _, x in ruled if x == v and learn(u)]) for v in ("allow", "block")}
    scores = {u: sum(math.log(a) - math.log(b) for a, b in zip(likelihoods(plain["allow"], u), likelihoods(plain["block"], u), strict=True)) / (len(url_markov.symbols_of(u)) - url_markov.ORDER) for u in {r[1] for r in rows}}
    wrong = 0
    for r in got:
        u = next(x[1] for x in rows if x[0] == r.page_id)
        host, path, rule, verdict = parted(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.difference - scores[u]) < 1e-6
        assert r.verdict == (verdict or ("allow" if r.score >= 0.5 else "block"))
        if not rule and ".edu" in (u or ""):
            wrong += (r.verdict == "block") != bool(re.match("http://[xzq]+[.]", u))
    assert wrong < 0.05 * len(rows)
    # the calibration: the least of the logistic loss over the URLs held out, in steps of the histogram, classes of equal weight
    held = [(round(scores[u] / url_markov.STEP) * url_markov.STEP, x == "allow") for u, _, x in ruled if x and not learn(u)]
    n = Counter(y for _, y in held)
    loss = lambda a, b: sum(math.log1p(math.exp(-(a * d + b) * (1 if y else -1))) / n[y] for d, y in held) + url_markov.RIDGE * a * a
    here = loss(model.slope, model.offset)
    assert all(here <= loss(model.slope + i, model.offset + j) + 1e-9 for i, j in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_urls_without_rules_or_rows(spark):
    assert url_markov.url_verdicts(spark.createDataFrame([], PAGES)).count() == 0
    one = url_markov.url_verdicts(spark.createDataFrame([(1, "http://a.edu/", None, None, None, None), (2, None, None, None, None, None)], PAGES)).collect()
    assert [(r.page_id, r.rule, r.verdict, r.score) for r in sorted(one)] == [(1, None, "allow", 0.5), (2, None, "allow", 0.5)]
    bad = [(i, f"http://{'xq' * (i % 5 + 1)}.net/{i}", None, None, None, None) for i in range(50)]
    got = url_markov.url_verdicts(spark.createDataFrame([*bad, (99, "http://xqxq.edu/1", None, None, None, None)], PAGES)).where("page_id = 99").first()
    assert got.verdict == "block"
