import random

import pytest
from pyspark.sql import types as T

from tests.conftest import SMALL  # noqa: F401

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty, very long and repeated texts, ties and repeated rows."""
    rng = random.Random(3)
    base = words(rng, 300)
    other = base.split()
    other[150] = "changed"
    passage = words(rng, 60)
    texts = [
        None, "", "   ", "x", base, base, base.upper(), " ".join(other), passage + " " + words(rng, 80), words(rng, 50) + " " + passage,
        words(rng, 30000), "la " * 5000, "z" * 50000, "été ÀÇ straße Σίσυφος ΟΔΟΣ İstanbul  x y\x1cz", "a <|endoftext|>b <|STARTOFTEXT|> it's 1234 ---", "ab" * 700, "漢字かな交じり文" * 40,
        "\t\n\x0b\x0c\r", "one two three", "one two three", None,
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s0", None, "s1")[i % 4], i) for i, t in enumerate(texts)]
    rows.append(rows[4])
    rows.append((None, base, "en", "s1", None))
    rows.append((7, "same id, another text", "fr", "s0", 1))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns whose names the operators use inside."""
    out = odd
    for name in ("id", "size", "chunk", "code", "content", "print", "shard", "_id", "held", "copies", "key", "h", "word", "idx"):
        out = out.withColumn(name, out["n_chars"])
    return out
