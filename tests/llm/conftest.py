import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside or for results
    T.StructField("score", T.StringType()), T.StructField("token", T.StringType()), T.StructField("n", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("component", T.StringType()), T.StructField("rate", T.StringType()),
])
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


def corpus() -> list[tuple]:
    """Ordinary texts, copies, near copies, a shared passage, nulls, empty and blank texts, a long text, repeated rows."""
    texts: list[tuple[int | None, str | None]] = [(k, " ".join(words(k, 40 + k))) for k in range(1, 13)]
    base = words(99, 120)
    texts += [(20, " ".join(base)), (21, " ".join(base)), (22, " ".join(w.upper() for w in base))]
    for k in (23, 24, 25):
        near = list(base)
        near[10 * (k - 20)] = f"edit{k}"
        texts.append((k, " ".join(near)))
    passage = " ".join(words(77, 60))
    texts += [(30, "Intro one. " + passage + " end one"), (31, "Another start: " + passage + " and tail"), (32, passage)]
    texts += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "one two three"), (45, "ONE two three"), (46, "12345 !!!")]
    texts += [(50, " ".join(words(5, 30_000))), (51, "é" * 300 + " ünï 漢字 🙂 x"), (52, "a" * 700)]
    texts += [(60, "same row " * 20), (60, "same row " * 20), (None, "no id here at all, but words enough"), (None, None)]
    return [(i, t, ("en", "de")[k % 2] if k % 5 else None, "s", 1, "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
