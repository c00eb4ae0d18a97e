import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text) pairs."""

    def build(rows, **extra):
        table = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")

    return build
