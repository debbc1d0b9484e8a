import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table out of (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)

    return make


@pytest.fixture
def folder_of(spark, tmp_path, docs_of):
    """A data folder with the given tables; documents as (doc_id, text) pairs."""

    def make(rows=(), **frames):
        for name, df in {"documents": docs_of(rows), **frames}.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def small():
    return SMALL
