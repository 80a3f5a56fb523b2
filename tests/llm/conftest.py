import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text[, lang, source]) as a table with clashing extra columns."""

    def make(rows, extra="_seen boolean, _row string, kept int, size long, _score double, cls string"):
        names = [c.split() for c in extra.split(", ")]
        filled = [(*r, *(None,) * (4 - len(r)), None, *(None,) * len(names)) for r in rows]
        return spark.createDataFrame(filled, DOCS + (", " + extra if extra else ""))

    return make
