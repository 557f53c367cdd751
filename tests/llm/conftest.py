from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, words string, body string, component_id long, copies long, `of` long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source), with further columns of names that operators
    use themselves."""

    def make(*rows, parts=3):
        full = [(r[0], r[1], *(r[2:] or ("en", "s1")), len(r[1] or ""), -1, -1, "w", "b", -1, -1, -1) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (None, "a text without an id"), (4, "one"), (4, "one"), (5, "nbsp stays 　 İ ſ K"), (6, "x" * 100_000), (7, "many words " * 20_000)]


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, repeated rows."""
    return docs(*ODD)


@pytest.fixture
def none(docs):
    """A table without rows."""
    return docs((1, "x")).where("doc_id < 0")
