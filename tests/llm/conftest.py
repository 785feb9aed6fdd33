"""Awkward inputs that every training-data operator must take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PROSE = "The thin edge of the reed and the thorn stood in the water. "
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "b", 0),
    (None, "No id here, mail a.b@c.de now", "en", None, 29),
    (3, PROSE * 3, "en", "a", 180),
    (3, PROSE * 3, "en", "a", 180),
    (3, "another text under the same id", "en", "b", 30),
    (4, "Über\U0001f600 den Flüssen liegt  \t\n ein Stein", "de", "a", 40),
    (5, "123 456 !!!", None, None, 11),
    (6, PROSE * 5_000, "en", "a", 300_000),
    (7, "a" * 50_000, "en", "é", 50_000),
    (8, "1" * 20_000 + "." + "2" * 20_000 + "@" * 500, "en", "a", 40_501),
    (9, "+" * 3_000 + "a.b" * 3_000, "fr", "Z", 12_000),
    (-5, " leading and trailing ", "", "", 22),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
