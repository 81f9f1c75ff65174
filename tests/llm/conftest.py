import sys

import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture()
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal ids, and columns with clashing names."""
    long = ("word%d " * 3 % (1, 2, 3)) * 4000 + "end"
    rows = [
        (1, "A short text of ten words that says nothing at all.", "en", "a", 51, "x", 1),
        (1, "A short text of ten words that says nothing at all.", "en", "a", 51, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "y", 2),
        (None, "No id here, mail me@example.org or not.", "en", "b", 39, "z", 3),
        (4, long, "en", "b", len(long), "z", 4),
        (5, "\n \t\n", "de", "b", 4, None, 5),
        (-7, "Ünïcödé 漢字 ▁ +1 (456) 555-2186 and 4111 1111 1111 1111 \U0001f600", "xx", "a", 60, "q", 6),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, host int")


sys.setrecursionlimit(10_000)
