import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def frame(texts, sources=None, first=0):
        rows = [(first + i, t, "en", (sources or [f"s{i % 3}" for i in range(len(texts))])[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return frame


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    words = [f"w{i % 977}" for i in range(40_000)]
    texts = [None, "", " \t\n", "one", "one two three four", "A b c d e", "a B c d e", " ".join(words), " ".join(words), "é" * 300_000, "x\u0000y z"]
    rows = [(i, t, None, None if i % 2 else "s", None, i, "k", 1.0) for i, t in enumerate(texts)]
    rows.append(rows[5])
    schema = DOCS + ", id long, key string, size double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
