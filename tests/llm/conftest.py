import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A ``documents`` table of (doc_id, text) pairs."""
    def make(pairs, **more):
        rows = [Row(doc_id=i, text=t, lang=more.get("lang", "en"), source="s", n_chars=len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)
    return make


# Nulls in every place, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "no id here"), (None, None), (5, "same words again " * 40),
    (6, "same words again " * 40), (7, "naïve café — 中文 text 😀 <|endoftext|> end"), (8, "x" * 70_000),
    (9, " ".join(f"w{i % 977}" for i in range(30_000))), (10, "A b C\x0bd\x0ce\rf\x85g h"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
