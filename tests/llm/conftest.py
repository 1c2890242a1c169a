import pytest

DATA = "/root/testdata"
LONG = ("Lorem ipsum dolor sit amet. " * 4000) + "\n" + "x" * 30000

#: Null ids and texts, empty and blank texts, ties, repeated rows, one very long text, and clashing extra columns.
ODD_ROWS = [
    (1, "", "en"), (2, None, "en"), (None, "some text without an id", None), (3, " \n\t ", "en"), (4, LONG, "en"),
    (5, "same words here", "en"), (5, "same words here", "en"), (5, "other words here", "en"), (6, "same words here", None), (7, "Été çà Éİ ﬁ \U0001f600 naïve", "fr"),
]
CLASHES = ("n_words", "shard", "slot", "secrets", "__group", "ids", "hits", "k1", "spans", "__hits", "__items", "__n_words", "__k", "__drop", "__id", "__key", "first_id", "row_key")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
