import random

import pytest

from tidemark.llm import queries  # noqa: F401  lets the operators travel with their plans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns that operators use inside; a table may have them as well.
CLASHING = (
    "size key rep component a b word rank term value start end base near all blob label target whole extra "
    "epochs taken cut_at at lane quota weight place draw rows digest bands class_digest query_id score shard"
).split()


@pytest.fixture
def docs(spark):
    def make(rows, clash=False):
        frame = spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            frame = frame.select("*", *[F.lit("x").alias(c) for c in CLASHING])
        return frame

    return make


@pytest.fixture
def prose():
    """Seeded texts of made-up words."""

    def make(seed, words=200, vocabulary=3000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))

    return make


def odd_rows(prose):
    """Nulls in every column, empty and very long texts, repeated rows."""
    return [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 6),
        (None, "no id here", "en", "b", 10),
        (4, "word " * 40_000, "en", "b", None),
        (5, "x" * 100_000, "de", "c", 100_000),
        (6, prose(6), "en", "c", None),
        (6, prose(6), "en", "c", None),
        (7, "12345 -- 678", "en", "c", 12),
    ]
