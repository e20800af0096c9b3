import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, u string, component string, rep long, label string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names the operators use themselves."""

    def build(rows):
        full = [Row(*(tuple(r) + (None,) * (3 - len(r))), "s", len(r[1]) if r[1] is not None else None, "r", "u", "c", 1, "l") for r in rows]
        return spark.createDataFrame([tuple(r) for r in full], DOCS)

    return build


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "no id here at all"), (5, "same text twice, five words"), (5, "same text twice, five words"), (6, "same text twice, five words"), (7, "x" * 300_000), (8, "word " * 60_000)]


@pytest.fixture
def edges(make):
    return make(EDGES)


@pytest.fixture
def nothing(make):
    return make([])
