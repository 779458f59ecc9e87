import pytest

#: Columns whose names clash with those that operators use inside.
EXTRA = "source string, lang string, n_chars long, fp long, rep long, node string, anchor long, words string, spans string, terms string, count long, body long, digest string"


def documents(spark, rows):
    """(doc_id, text) rows with clashing extra columns."""
    width = len(EXTRA.split(","))
    return spark.createDataFrame([(i, t, *[None] * width) for i, t in rows], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, a null id."""
    long = " ".join(f"considering{i % 97}x{i}" for i in range(30_000))
    return documents(spark, [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "one two three"), (5, "one two three"), (None, "text without an id"), (6, "naïve 😀 ünïcode text\x1c here")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
