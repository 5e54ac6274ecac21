import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) tuples."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string{extra}")

    return make

