"""Small tables with the cases that every operator must handle."""

from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 20_000
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, copies, a repeated row, no ids, and clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, 7, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1, "y"),
        (4, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 5, 7, "x"),
        (5, LONG, "en", "b", len(LONG), 2, "z"),
        (6, "  \n\t ", "fr", "b", 5, 3, None),
        (7, "Élan vital, ça va? 漢字 test \x00 end", "fr", "c", 30, 4, "w"),
        (7, "Élan vital, ça va? 漢字 test \x00 end", "fr", "c", 30, 4, "w"),
        (None, "no id at all", "en", "c", 12, 5, "v"),
        (9, "the quick brown fox jumps over the lazy dog again and AGAIN", "en", "b", 5, 7, "x"),
    ]
    return spark.createDataFrame(rows, DOC + ", id long, key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, None), (5, None, 1), (None, 0, 0), (7, 0, 1), (77, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
