import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # names that operators use for results
    *[T.StructField(n, T.StringType()) for n in ("Size", "kept", "score", "spans", "leak", "shard", "slot", "chunk", "fp", "key", "label", "target")],
])
EXTRA = ("mine",) * 12


def words(rng, n, stock="abcdefghij"):
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randint(1, 6))) for _ in range(n))


def awkward_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, copies, one source and one text with a third of all rows."""
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 5}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", "hot") for i in range(40)]
    rows += [(200 + i, texts[1] + " \n" * (i % 3), None, "hot") for i in range(9)]
    rows += [(300, None, "en", "s1"), (301, "", "en", None), (302, " \t\n\x0b\f\r", None, None), (303, "1234 !!", "fr", "s2"), (None, texts[2], "en", None), (None, texts[3], "fr", "s3")]
    rows += [(400, texts[4], "en", "s4")] * 3 + [(None, None, None, None)] * 2
    rows += [(500, words(rng, 60_000), "en", "s0"), (501, "x" * 200_000, "fr", "s0"), (502, "Ünï çødé 日本 😀 naïve", "fr", "ü")]
    return rows


@pytest.fixture(scope="session")
def awkward():
    return awkward_rows()


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    return spark.createDataFrame([r + EXTRA for r in awkward], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
