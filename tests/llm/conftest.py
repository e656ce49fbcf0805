import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), "src", None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
