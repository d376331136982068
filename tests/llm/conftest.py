"""Small hand-made tables for the corpus operators."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, label string, norm string"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with further columns whose names operators use inside."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", None, None, "k", "f", "l", "n") for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def empty(docs):
    return docs()


def rows(df, *names):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)
