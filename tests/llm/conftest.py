import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, id string, label string"


def corpus(n=60, seed=1):
    """Texts with copies, near copies, long, blank and null ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 20, 60, 120]))) for _ in range(n)]
    for k in range(0, n, 6):
        texts.append(texts[k])
        near = texts[k].split()
        if len(near) > 30:
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", "  \n\t ", "one", "Ünïcode ÀB \U0001f600 text", "x" * 50_000, " ".join(rng.choices(words, k=9000))]
    return texts


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t), "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Repeated rows and null ids."""
    some = texts[:20]
    return frame(spark, [*some, *some, None, "lost text"], [*range(20), *range(20), None, None])
