import pytest


@pytest.fixture
def docs_frame(spark):
    """documents with given (doc_id, text, lang) rows and columns that clash with the operators' own names."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, lang, "src", len(t or ""), "x", 7, "y") for i, t, lang in rows],
            "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, keep_id string")
    return make


EDGE_ROWS = [
    (1, "The cat sat on the mat today.", "en"), (2, "the CAT sat on the mat today.", "en"),
    (3, None, None), (4, "", "en"), (5, "   ", None), (None, "a row without id", "en"),
    (7, "Élan", "fr"), (8, "élan", "fr"), (9, "word " * 30000, "en"),
    (1, "The cat sat on the mat today.", "en"), (None, "a row without id", "en"),
    (10, "one", "en"), (11, "one two", "en"), (12, "x" * 50000, "de"),
]


@pytest.fixture
def edge_rows():
    return list(EDGE_ROWS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
