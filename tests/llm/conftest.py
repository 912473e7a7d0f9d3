import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


CLASHING = ["_row", "_copies", "_copy", "copies", "size", "_lang", "_score", "fp", "component_id", "_n", "_w", "_p", "_h", "ids", "decoded", "hits", "spans", "rank", "score", "part"]


def _edge(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows], schema)


EDGE = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (5, "one", "en", "b"), (None, "a text without an id", "en", "a"), (None, None, None, None),
    (6, "long words go on and on " * 20_000, "en", "c"), (7, "x" * 200_000, "en", "c"), (8, "日本語のテキスト 漢字", None, "c"), (9, "1234 5678 !!", "en", "a"), (10, "word " * 3, "fr", "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in each column, empty and very long texts, repeated rows, and further columns whose names clash."""
    return _edge(spark, EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return _edge(spark, [])
