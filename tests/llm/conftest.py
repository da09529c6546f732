import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture()
def docs_of(spark):
    """Documents from texts, dealt over a few partitions."""
    def make(texts, **more):
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        return spark.createDataFrame([(i, t) for i, t in rows], DOCS).repartition(3)

    return make
