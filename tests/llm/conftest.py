import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("id", T.LongType()), T.StructField("row", T.LongType())])


@pytest.fixture
def make(spark, tmp_path):
    """A stored table of (doc_id, text[, lang]) rows, with columns whose names operators use themselves."""

    def table(rows, name="docs"):
        path = str(tmp_path / name)
        spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "x", 7, 7) for r in rows], DOCS).repartition(3).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return table


ODD = [(1, None), (2, ""), (3, " \n"), (4, "One two three four"), (4, "One two three four"), (None, "one TWO three four"), (None, None), (5, "x"), (6, "Éa é"), (7, "word " * 3000)]


@pytest.fixture
def odd(make):
    return make(ODD, "odd")


@pytest.fixture
def empty(make):
    return make([], "empty")
