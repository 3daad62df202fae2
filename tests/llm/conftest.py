import pytest
from pyspark.sql import functions as F

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 4000


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as operators name theirs."""
    rows = [
        (1, "A plain text of a few words, no more than that.", "en", "a"),
        (1, "A plain text of a few words, no more than that.", "en", "a"),
        (2, "A plain text of a few words, no more than that.", None, None),
        (3, None, "en", "b"),
        (4, "", "fr", "b"),
        (5, " \n\t ", None, "a"),
        (6, "12345 67890 !!!", "en", None),
        (7, LONG, "en", "a"),
        (8, "Été à la plage, où ça ? 日本語 🙂 password = hunter22", "fr", "c"),
        (None, "A text without an id.", "en", "a"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["node", "size", "key", "shard", "slot", "salt", "order", "held_out", "spans", "base", "found", "class", "group", "copies", "n_bytes", "media", "score", "root", "range", "part"]
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
