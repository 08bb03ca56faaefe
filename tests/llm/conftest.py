"""Hostile rows that every operator has to bear."""

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

LONG = "word another thing " * 20_000
ROWS = [
    # doc_id, text, lang, source, n_chars, and columns whose names operators use themselves
    (1, None, None, None, None, "x", 1.0, True),
    (2, "", "en", "a", 0, None, None, None),
    (3, " \t\n", "en", "a", 3, "x", 1.0, True),
    (4, "The same text in two rows of one id, long enough to count as a document of some words.", "en", "b", 86, "x", 1.0, True),
    (4, "The same text in two rows of one id, long enough to count as a document of some words.", "en", "b", 86, "x", 1.0, True),
    (5, "THE SAME text in two rows of one id, long enough to count as a document of some words.", "en", None, 86, "x", 1.0, True),
    (None, "A row without an id, but with a text that nobody else has in this table.", "de", "c", 72, "x", 1.0, True),
    (None, None, None, None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG), "x", 1.0, True),
    (7, "123 456 !!", "fr", "c", 10, "x", 1.0, True),
    (8, "mail a.b@c.de or +49 30 1234567, 4111 1111 1111 1111 from 10.0.0.1 <|endoftext|> 日本", "fr", "c", 80, "x", 1.0, True),
]
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, score double, Kept boolean"
)


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
