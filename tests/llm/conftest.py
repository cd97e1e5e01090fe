import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, lang]) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, a long text, ties and repeated rows."""
    long_ = "\n".join(f"the word{i % 977} of a line number {i}" for i in range(4000))
    return make_docs(
        (None, "a row without id, but with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, long_), (6, long_),
        (7, "12 34 !!"), (8, "ﬁne 日本語 ▁ text", None), (9, "Same text. Same text.\nSame text. Same text.\nSame text.", None))
