from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows: list[tuple], parts: int = 3):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(parts)

    return make


LONG = " ".join(f"word{k}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows and ties."""
    return make_docs(
        [
            (1, None, "a"),
            (2, "", "a"),
            (3, " \n\t ", None),
            (None, "a null id has a text of some ten words or more here", "b"),
            (4, "one two three", "b"),
            (5, "one two three", "b"),
            (5, "one two three", "b"),
            (6, LONG, "a"),
            (7, LONG + " tail", "a"),
            (8, "Ünï 中文字 \U0001f600 x y\x1cz ▁ a  b   c", "c"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
