import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    def make(rows):
        full = [(doc_id, text, lang, source, None if text is None else len(text), "extra", "extra") for doc_id, text, lang, source in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)
    return make


ODD_TEXTS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "x" * 200_000, "en", None),
    (5, "plain words here", "en", "a"), (5, "plain words here", "en", "a"), (None, "no id at all", None, "a"),
    (7, "naïve 日本語 🙂\n\n  spaced   out \n", "fr", "b"), (8, "$$$ ### ***", "en", "b"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD_TEXTS)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
