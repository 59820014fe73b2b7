import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "Lorem ipsum " * 9000


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, source) -> a table like documents, with further columns whose names operators use inside."""

    def make(rows, extra=True):
        full = [(i, t, "en" if s else None, s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("maybe", "row", "mine", "gone", "size", "k", "id", "rid", "digest_key", "kept", "n", "copies", "target", "score", "part", "component_id", "lines", "n_lines", "left", "curve", "bands"):
                df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return [(1, "same text here", "a"), (2, "same text here", "b"), (2, "same text here", "b"), (3, None, "a"), (4, "", None), (None, "no id at all", "c"), (5, " \n\t ", "a"), (6, LONG, "b"), (7, "tie", "c"), (8, "tie", None), (None, None, None), (6, LONG, "b")]
