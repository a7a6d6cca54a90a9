import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use inside.
CLASHES = ("row", "node", "key", "id", "root", "place", "start", "__text", "__kept", "range", "block", "slot", "source_", "n", "line", "least")


def words(rng: random.Random, n: int) -> str:
    """Prose of invented words: all different enough that no two texts are alike."""
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source): with the other columns null, and extra columns whose names clash."""

    def build(rows, extra=True):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        names = CLASHES if extra else ()
        fields += [T.StructField(c, T.StringType()) for c in names]
        return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), *["x"] * len(names)) for i, t, s in rows], T.StructType(fields))

    return build


@pytest.fixture(scope="session")
def messy(make):
    """Nulls, empty and blank texts, repeated rows, one very long text."""
    rng = random.Random(1)
    a, b, long = words(rng, 120), words(rng, 80), words(rng, 60_000)
    rows = [(1, a, "p"), (1, a, "p"), (2, a, None), (3, b + "\n" + a, "q"), (None, a, "p"), (None, None, None), (4, None, "p"), (5, "", "q"), (6, " \n\t ", "q"), (7, long, "p"), (8, "é" * 30, ""), (9, words(rng, 90), "q")]
    return make(rows), rows


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
