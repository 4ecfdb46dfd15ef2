import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts."""

    def make(texts, sources=None):
        rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
