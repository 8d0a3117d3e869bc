import pytest

LONG = "lorem ipsum dolor " * 4000
#: Nulls, empty and very long texts, ties, repeated rows, white space only, and columns named like internals.
ODD = [
    (1, "a b c d e f", "s1", "x", 1), (1, "a b c d e f", "s1", "x", 1), (2, "a b c d e f", "s1", "x", 2), (None, "a b c d e f", None, "x", 3),
    (3, None, "s2", None, None), (4, "", "s2", "", 0), (5, " \t\n", None, "y", 5), (6, LONG, "s3", "z", 6), (7, LONG + "end", "s3", "z", 7),
    (8, "é😀\x00 ​", "", "q", 8), (None, None, None, None, None), (9, "A B C D E F", "s1", "x", 9),
]
ODD_SCHEMA = "doc_id long, text string, source string, key string, size long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("*", "'w' AS _row", "'v' AS h", "7 AS taken", "'k' AS shard", "1 AS n", "'b' AS bucket", "'p' AS print", "'d' AS _kept")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small(docs):
    """Id and text pairs of the smallest documents table."""
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
