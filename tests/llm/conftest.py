import pytest
from pyspark.sql import functions as F

LONG = "der und straße zwölf +1 (212) 555-0199 " * 4000
ROWS = [
    (1, "The cat sat on the mat. token = 'abcdefghijkl0123'", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n\n ", "en"),
    (5, LONG, "de"),
    (6, "The cat sat on the mat. token = 'abcdefghijkl0123'", "en"),
    (6, "The cat sat on the mat. token = 'abcdefghijkl0123'", "en"),
    (7, "12345 !!! 😀 10.0.0.1 a.b@c.example.org", None),
    (None, "le chat noir", "fr"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows; extra columns with names
    that operators use for their own."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").coalesce(2)
    extra = ("score", "spans", "slice", "block", "key", "n_words", "simhash", "bucket", "part", "head", "row", "fp")
    return docs.withColumns({name: F.lit("x") for name in extra})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("doc_id < 0")
