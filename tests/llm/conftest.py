"""Small tables that the tests of the corpus operators share."""

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997} item{i}." for i in range(30000))
    rows = [
        (1, "one two three. four five six.", "en", "a", 10),
        (1, "one two three. four five six.", "en", "a", 10),
        (1, "another text of the same id", "en", "b", 5),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "text without an id", "en", "a", 18),
        (None, None, None, None, None),
        (4, long, "en", "a", len(long)),
        (5, long + " tail", "en", None, len(long) + 5),
        (6, " \n\t ", "de", "b", 4),
        (7, "ÄÖÜ ñandú été 你好!", "es", "c", 18),
    ]
    d = spark.createDataFrame(rows, DOCS)
    for name in ("k", "bin", "tokens", "digest", "group_id", "keep", "at", "bucket", "total", "n", "id", "levels", "__mix_last", "last", "__k", "__c", "__r"):
        d = d.withColumn(name, d["doc_id"])
    return d


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
