import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None, sources=None, extra=False):
        rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "s0",
                 None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:  # names that the operators use themselves
            for c in ("score", "fp", "_id", "_hash", "dropped", "component_id", "size", "label", "lang_pred", "word"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df
    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, a null id, clashing
    extra columns."""
    texts = ["One line here.\nAnd another line", None, "", "   \t\n", LONG, "x", "One line here.\nAnd another line",
             "É ß 日本 \x00 end", "12345 67890", "Twice twice twice"]
    return make_docs(texts + texts[:1], ids=[*range(9), None, 0], sources=["a", None, "b", "b", "a", None, "c", "a", "b", "a", "a"],
                     langs=["en", None, "fr", "en", "en", "de", "en", "fr", "en", "en", "en"], extra=True)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
