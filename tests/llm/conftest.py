import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Extra columns with names that operators use inside.
    T.StructField("kept", T.StringType()), T.StructField("words", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("spans", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("trusted", T.StringType()),
])
WORDS = "river stone cloud garden window paper light music forest bridge yellow quiet morning letter silver market".split()
TEXT = " ".join(WORDS[(i * 7 + i // 5) % 16] + str(i % 13) for i in range(80)) + "."


def row(i, text, lang="en"):
    return (i, text, lang, "src0", len(text) if text is not None else None, "x", "y", 1, "z", 0, "t")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [row(1, TEXT), row(2, TEXT), row(2, TEXT), row(3, None), row(4, ""), row(5, " \t\n "), row(None, TEXT + " more"), row(None, None, None), row(6, "w" * 150_000), row(7, (TEXT + "\n") * 60), row(8, "Short text."), row(9, "mail a.b@c.example.org or 10.1.2.3", None), row(10, "x\x00y \U0001f600 zé")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (7, 1, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(TEXT.split()[10:40])), (2, "too short"), (3, None), (None, TEXT), (1, " ".join(TEXT.split()[10:40]))], "item_id long, text string")
