"""Shared values of these tests; the session comes from the folder above."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty, blank and long texts, ties and repeated rows."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \t\n", "en", None, 3),
        (None, "the cat sat on the mat", "en", "a", 22),
        (4, "the cat sat on the mat", "en", None, None),
        (4, "the cat sat on the mat", "en", None, None),
        (5, "The CAT sat on\tthe mat", None, "b", 22),
        (6, "été 日本語 <|endoftext|> 'll don't  x y", "fr", "b", 40),
        (7, "word " * 60_000, "en", "b", 300_000),
        (8, "x" * 50_000, None, "c", 50_000),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
