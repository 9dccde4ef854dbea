import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and repeated rows, ties, a long text, and columns whose names the operators use themselves."""
    rows = [
        (1, "a b c d e f g", "en", "s", 1, 5), (2, "a b c d e f g", None, None, None, None), (2, "a b c d e f g", None, None, None, None), (3, None, "en", "s", 0, 1), (4, "", "en", "s", 0, 1),
        (5, " \n\t", "en", "s", 3, 1), (None, "lost text without an id", "en", "s", 1, 1), (None, None, None, None, None, None), (6, "A  B\nC d e f g", "en", "s", 1, 1),
        (7, "long " * 30_000, "en", "s", 1, 1), (8, "one", "en", "s", 1, 1), (9, "ONE", "en", "s", 1, 1), (10, "mail x@y.org, é ü 🙂", "en", "s", 1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
