import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    long_text = "longword" * 9000 + " " + "tail of a long text é😀 " * 500
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, "same text"), (5, "same text"), (6, "same text"), (None, "no id"), (None, None), (7, "x"), (8, "a\u0000b\u2028c")]
    rows = [(i, t, "start", 1, [2], None) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_words int, pieces array<int>, content binary").withColumnRenamed("n_words", "length")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
