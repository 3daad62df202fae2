"""A corpus pipeline: language, near-duplicates, secrets, mixing, packing.

Each stage takes the documents that its predecessor kept, as Parquet, and returns documents; the last returns packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, neardup, packing, secrets
from tidemark.llm.common import read, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language can't be told: no letter, or a calibrated probability below this many times that of a guess (at most the second figure).
TIMES_A_GUESS, LEAST_SCORE = 1.6, 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language; where none is given, the predicted one is set. Where no document has a language, all with a letter stay."""
    model = langid.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = langid.predict(docs, model, keep=COLUMNS)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= min(LEAST_SCORE, TIMES_A_GUESS / len(model.languages)))
    return told.filter(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.deduplicate(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blotted out."""
    found = secrets.scan_secrets(docs, keep=COLUMNS)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of 4096 tokens: one row for each piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixing_weights),
    ("packing", packed),
]

#: Learned and sampled stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
