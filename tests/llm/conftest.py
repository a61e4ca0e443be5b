import pytest

#: Rows with nulls in any column, empty and blank texts, repeats, ties and long texts.
LONG = "word " * 30_000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "s1"), (2, "the QUICK brown fox jumps over the lazy dog.", "en", "s1"), (3, "", "en", "s1"), (4, None, None, None),
    (None, "no id here at all", "fr", "s2"), (5, LONG, "en", "s1"), (1, "The quick brown fox jumps over the lazy dog.", "en", "s1"), (6, "  \n\t ", None, "s2"), (7, "ß é 日本 <|endoftext|> \r\n x", "de", None), (8, "12 34", "en", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above, and columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"fingerprint": F.lit("x"), "n_tokens": F.lit(1), "score": F.lit("y"), "fp": F.lit(2), "mix": F.array(F.lit(1))})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
