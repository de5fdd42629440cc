from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard int, score double, words string"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, columns named like results."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 5, "x", 7, 0.5, "w"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 5, "x", 7, 0.5, "w"),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "", 0, 0.0, ""),
        (4, " \n\t ", "en", "a", 4, "", 0, 0.0, ""),
        (None, "text without a number", "en", None, 3, "", 0, 0.0, ""),
        (5, "Alpha BETA gamma delta epsilon zeta eta theta", "en", "b", 5, "x", 7, 0.5, "w"),
        (6, "é ß Σ 日本語 \x00 \x1c 😀 'quoted' it's", "fr", "a", 1, "", 0, 0.0, ""),
        (7, "long " * 30_000 + "\n" + "line\n" * 2000, "en", "c", 9, "", 0, 0.0, ""),
        (8, "one", "en", "c", 9, "", 0, 0.0, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
