import pytest

from tallyproof.llm.common import importable


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    importable(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Rows of documents-like tables: (id, text) or more columns."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)
    return make


#: Texts that every operator must take: null, empty, white space, one word, repeated rows, no ASCII, one very long word.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "same text here again"), (5, "same text here again"), (6, "日本語 のテキスト é ß"),
       (7, "x" * 5000), (None, "row without an id"), (8, "same text here again"), (9, "   ... --- !!!")]
