import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, part long, batch long, digest string"


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "er", "the", "st", "ou", "é"], k=rng.randint(1, 4))) for _ in range(n))


def rows(seed=3, n=40):
    """Nulls in every column, empty and long texts, exact and near copies, shared passages, repeated rows and ids."""
    rng = random.Random(seed)
    passage = prose(rng, 90)
    texts = [prose(rng, rng.choice([1, 3, 12, 60, 150])) for _ in range(n)]
    base = prose(rng, 120).split()
    for k in range(8):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], " ".join(base), f"{prose(rng, 30)} {passage} {prose(rng, 9)}", f"{passage}\n{prose(rng, 30)}", "be " * 400, "é" * 900, "", None, "   ", passage[:400], "a\x0bb\x1cc  d\r\n"]
    texts.append(prose(rng, 9000))
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 5, 1, 0.5, 7, 8, "z") for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, "no id here at all", None, None, None, None, None, None, None, None), (None, passage, None, "s1", None, None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
