import pytest
from pyspark.sql import functions as F
from samples import CLASHES, SCHEMA, words

@pytest.fixture
def docs(spark):
    """Rows ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` as a documents table."""
    def make(rows):
        full = [(*r, *([None] * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "another text of id four"), (None, "no id at all here"),
        (None, "no id at all here"), (None, None), (7, words(7, 3000)), (8, words(7, 3000)), (9, "ONE"), (10, "1234 56 !!"),
        (11, "é Ü ñ 日本語 🎉"), (12, "x" * 30_000), (13, "a\x00b"),
    ]
    df = docs(rows)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture
def none(docs):
    return docs([])
