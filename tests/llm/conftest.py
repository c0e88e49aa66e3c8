import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, gram string, term string, size int, shard int, score double, id string, of int, n int, items string, spans string, taken int, line string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and blank and very long texts, repeated rows, extra columns of clashing names."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    some = " ".join(words[:60])
    texts = [(1, some), (2, None), (3, ""), (4, " \n\t "), (5, " ".join(rng.choice(words) for _ in range(30_000))), (6, some), (6, some), (7, "x"), (None, "one two"), (8, some + " end"), (9, "É" * 50 + " \U0001f600 tail")]
    more = (1, "g", "t", 2, 3, 0.5, "i", 4, 5, "s", "p", 6, "l")
    rows = [(i, t, None if i in (3, 5) else "en", None if i in (2, 7) else f"s{(i or 0) % 2}", None, *more) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
