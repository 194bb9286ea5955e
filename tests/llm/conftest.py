import pytest
from pyspark.sql import types as T

EXTRA = ["lang", "n", "pos", "h1", "shingle", "rank", "other_id", "__text_hash", "__drop", "__key", "__gone", "__had", "a.b", "TEXT", "Doc_Id", "row", "c1"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


@pytest.fixture
def docs(spark):
    """Documents of (id, text) with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, *[f"{c} of {i}" for c in EXTRA]) for i, t in rows], SCHEMA)

    return make
