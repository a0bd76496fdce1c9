"""Rows that every text operator must bear."""

import pytest

AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, "   \n\t ", "en", None, 6),
    (4, "word", "xx", "b", 4),
    (5, "word", "xx", "b", 4),
    (5, "word", "xx", "b", 4),
    (None, "a null id", "en", "c", 9),
    (7, "é" * 50 + " 🎉 " + "中文" * 40, "fr", "c", None),
    (8, "long words and lines\n" * 8000, "en", "d", 168000),
    (9, "x" * 150_000, "en", "d", 150000),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
