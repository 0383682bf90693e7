import pytest

from riskframe.llm.text import session


@pytest.fixture(scope="session")
def llm(spark):
    return session(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, fp string, w string"


@pytest.fixture(scope="session")
def make_docs(llm):
    """Documents with extra columns whose names the operators use inside."""
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "v") for i, t in zip(ids, texts)]
        return llm.createDataFrame(rows, DOCS).repartition(3)
    return make
