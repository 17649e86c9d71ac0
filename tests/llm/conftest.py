import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A DataFrame of (doc_id, text, lang) rows."""

    def make(rows, more=""):
        schema = "doc_id bigint, text string, lang string" + more
        return spark.createDataFrame(rows, schema)

    return make
