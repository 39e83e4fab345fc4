import pytest

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text and columns with clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon tonight", "en", 5, 0.5), (2, "The cat sat on the mat and looked at the moon tonight", "en", 5, 0.5), (2, "The cat sat on the mat and looked at the moon tonight", "en", 5, 0.5),
        (3, None, "en", None, None), (4, "", None, 1, None), (5, " \t\n ", "de", 1, 1.0), (None, "nobody knows this text by its number", "en", 1, 1.0), (6, "12345 67890 !!! ???", "fr", 1, 1.0),
        (7, "Der Hund läuft über die Straße und die Katze schläft im Garten", "de", 1, 1.0), (8, "x", None, 1, 1.0), (9, "wort " * 60_000, "de", 1, 1.0), (10, "a" * 250_000, None, 1, 1.0), (11, "日本語のテキスト \U0001f600 é", None, 1, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines int, score double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
