import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = "word " * 60_000
    rows = [
        (1, None, "a", None), (2, "", "a", 1), (3, "   \n", None, 2), (4, "same text here today", "b", 3),
        (5, "same  text\there today", "b", 4), (5, "same  text\there today", "b", 4), (None, "no id", "a", 5),
        (6, long, "a", 6), (7, long, None, 7), (8, "é ü 漢字   x", "c", 8), (9, "x" * 20_000, "c", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size long")
