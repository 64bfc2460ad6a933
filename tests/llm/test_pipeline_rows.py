"""The pipeline's rows against plain Python, and its restart."""

import hashlib
from collections import Counter

import pytest

from tests.llm.test_dedup import bytes_brute, classes_brute


@pytest.fixture(scope="module")
def plain(spark):
    """A table with every kind of group, and labels by which long words are good."""
    import random

    rng = random.Random(21)
    word = lambda good: "".join(rng.choices("aeiou" if good else "xzq#", k=rng.randint(2, 6)))
    passage = " ".join(word(True) for _ in range(150))
    rows = []
    for i in range(160):
        good = i % 4 != 0
        text = " ".join(word(good) for _ in range(rng.choice([20, 60, 200])))
        if good and i % 10 == 3:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200, rows[5][1], "en", "s0", 5), (201, rows[6][1] + " end", "en", "s1", 5)]
    labels = [(r[0], int(r[0] % 4 != 0), 0) for r in rows if r[0] < 150]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_each_stage_and_the_whole(spark, plain, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from veridicta.llm import compression
    from veridicta.llm.packing import TOKENIZER

    docs, labels = plain
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    labels.write.parquet(f"{tmp_path}/in/labels.parquet")
    folder = f"{tmp_path}/stages"
    final = p.run(spark, f"{tmp_path}/in", folder).collect()
    at = [[tuple(r) for r in spark.read.parquet(f"{folder}/{name}").collect()] for name, _ in p.STAGES[:-1]]
    good = {r["doc_id"] for r in compression.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r[0] for r in at[0]} == good and sum(i % 4 != 0 for i in good) / len(good) > 0.9
    heads = {c for _, c in classes_brute([r[:2] for r in at[0]])}
    assert {r[0] for r in at[1]} == heads
    want = bytes_brute([r[:2] for r in at[1]])
    assert Counter((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in at[2]) == Counter((w[0], w[4]) for w in want)
    assert {r[0] for r in at[3]} <= {r[0] for r in at[2]} and all(r in at[2] for r in at[3])
    taken = Counter(r[0] for r in at[3])
    assert max(taken.values()) <= 3
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    sizes = Counter()
    for r in at[3]:
        n = len(whole.encode(r[1], add_special_tokens=False).ids) + 1
        for k in range(0, n, 4096):
            sizes[r[0], min(4096, n - k)] += 1
    assert Counter((r["doc_id"], r["length"]) for r in final) == sizes
    # a stage that is there is not made again; one that is missing is
    stamp = {n: (tmp_path / "stages" / n / "_SUCCESS").stat().st_mtime_ns for n, _ in p.STAGES[:-1]}
    (tmp_path / "stages" / "source_mix" / "_SUCCESS").unlink()
    assert p.run(spark, f"{tmp_path}/in", folder).count() == len(final)
    again = {n: (tmp_path / "stages" / n / "_SUCCESS").stat().st_mtime_ns for n, _ in p.STAGES[:-1]}
    assert [n for n in stamp if stamp[n] != again[n]] == ["source_mix"]
