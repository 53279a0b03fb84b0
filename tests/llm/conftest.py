import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows and one very long text."""
    rng = random.Random(3)
    words = ["ba", "ce", "dif", "Gol", "hum", "été", "x1", "zz.", "q,"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(30_000))
    line = " ".join(rng.choice(words) for _ in range(30))
    texts = [None, "", " \t\n", "one", "two words", line, line, line + " end", line + "\n" + line + "\n\n" + line, long, "\u2003é\u00a0ü", "# $ % &\n|<>"]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(20)) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "é", None, ""]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, "no id", None, None, None), (None, None, None, None, None), rows[5], rows[5], rows[9]]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(odd_rows(), DOCS)
    extra = ["bin", "kind", "size", "h", "range", "key", "fp", "__k", "rid", "item", "length", "component_id", "kept", "score"]
    return df.withColumns({c: F.lit("x") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
