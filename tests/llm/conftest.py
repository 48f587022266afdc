import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def make(spark):
    """DataFrames from rows and a schema text."""

    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def odd_docs(make):
    """NULL in every column, empty and white texts, repeated rows, a long text, a clashing column."""
    long = " ".join(f"word{i % 977}" for i in range(30_000)) + "."
    rows = [
        (1, None, "x", 5),
        (2, "", None, 6),
        (3, " \t\n \r\n", "x", None),
        (None, "A text without an id.", "x", 1),
        (4, long, "x", 1),
        (4, long, "x", 1),
        (5, "é漢🙂   ÄÖ", "x", 1),
        (6, "﻿\x00\x1c\x85", "x", 1),
    ]
    return make(rows, "doc_id long, text string, n_words string, kept long")


@pytest.fixture(scope="session")
def no_docs(make):
    return make([])


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) if isinstance(r, Row) else r for r in df.collect()]
