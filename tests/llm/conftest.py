import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("lang", "source", "score", "n", "key", "row_mark", "spans", "copy", "component", "root")]
)


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank and long texts, ties, repeated rows, copies, near copies, shared passages."""
    rows: list[tuple] = [(None, "no id at all"), (None, None), (1, None), (2, ""), (3, " \n\t\x0b "), (4, "word"), (5, "Two Words"), (6, "two words")]
    base = passage(1, 120)
    rows += [(10, base), (11, base), (12, base + " one more"), (13, base.upper()), (13, base.upper())]
    rows += [(20 + i, passage(2, 60) + f" tail{i} " + passage(100 + i, 40)) for i in range(6)]
    rows += [(30, passage(3, 30) + "\n" + passage(2, 60)), (31, passage(5, 3000)), (32, "É日本 ſ <|endoftext|> it's 'tis x y 😀"), (32, "other text of the same id")]
    rows += [(40 + i, passage(200 + i, 80).replace(" ", "\n", 3)) for i in range(10)]
    rows += [(60, "a " * 200), (61, "x" * 5000), (62, "\r\n".join(passage(300 + i, 5) for i in range(30)))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = ("en", "src", "s", "n", "k", "m", "p", "c", "o", "r")
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
