import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with nulls, empty and repeated rows, ties and an extra column with a clashing name."""

    def make(rows):
        full = [(*r, *[None] * (5 - len(r)), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, uid string")

    return make
