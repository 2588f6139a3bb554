"""Small tables with the awkward cases every text operator must define."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with awkward names."""
    long_text = " ".join(f"word{k % 977} and{k % 13}" for k in range(60_000))
    rows = [
        (1, "one two three four five", "en", "a", 23), (1, "one two three four five", "en", "a", 23), (2, None, None, None, None),
        (3, "", "en", "b", 0), (None, "no id at all here", "en", "a", 17), (None, None, None, None, None), (5, " \t\n ", "en", "b", 4),
        (6, long_text, "en", "a", len(long_text)), (7, long_text, "en", None, len(long_text)), (8, "Ünï cödé 😀 text ÄÖ", "de", "é", 19),
        (9, "x", "en", "b", 1), (9, "other text under the same id", "en", "b", 28),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    names = ["size", "copies", "row", "fp", "hash", "bucket", "queue", "part", "shard", "slot", "host", "token", "of", "n", "words", "id", "src", "odds", "step", "first", "component_id", "kept"]
    return frame.select("*", *[F.lit(k).alias(name) for k, name in enumerate(names)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
