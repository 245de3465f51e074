import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with columns that clash with names the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, spans int")

    return make
