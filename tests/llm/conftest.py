import pytest


@pytest.fixture
def docs(spark):
    """(doc_id, text) rows to a table with the columns of documents and two clashing extra ones."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src", len(t) if t is not None else None, "mine", 7) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words int",
        )

    return make
