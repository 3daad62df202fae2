"""Playbooks as tables: the first keyword that a text holds, or the key that shares most words with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranks import running

#: Bytes of keywords that one automaton holds; every task gets it. A larger table is searched for in several passes.
AUTOMATON_BYTES = 4 << 20
DEFAULT = "default"

TABLE = T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("risk_factor_keyword", "intervention", "message", "cost")]])
# The rows that a playbook table is seeded with, in match order.
SEEDS = [
    (1, "satisfaction", "Proactive Support Call", "Reach out to understand and resolve the satisfaction issue before they escalate.", "Medium ($10–25)"),
    (2, "complain", "Service Recovery", "Apologise directly, offer a goodwill gesture, and close the loop on the complaint.", "Medium ($10–25)"),
    (3, "days_since_last_order", "Reactivation Campaign", "Send a personalised win-back offer highlighting new products relevant to past purchases.", "Low ($1–5)"),
    (4, "tenure", "Loyalty Reward", "Recognise their loyalty with an exclusive member reward to reinforce the relationship.", "Low ($1–5)"),
    (5, "order_count", "Personalized Content", "Send curated product recommendations based on their purchase history to re-engage browsing.", "Low ($1–5)"),
    (6, "cashback", "Discount Offer", "Offer a targeted cashback or discount on their next order to incentivise return.", "Low ($1–5)"),
    (7, "default", "Personalized Content", "Send a personalised re-engagement email with relevant content.", "Low ($1–5)"),
]


def seeds(spark: SparkSession) -> DataFrame:
    """The seed rows of the playbook table."""
    return spark.createDataFrame(SEEDS, TABLE)


def _parts(words: DataFrame, order: list[Column]) -> Iterator[list[tuple]]:
    """The rows of (word, ...) in parts of at most ``AUTOMATON_BYTES``, one at a time."""
    sized = running(words.filter(F.col("word") != ""), [], order, {"_upto": F.octet_length("word") + 8}).withColumn("_part", F.expr(f"_upto div {AUTOMATON_BYTES}")).persist()
    most = sized.agg(F.max("_part")).first()[0]
    for k in range(0 if most is None else most + 1):
        rows = [tuple(r) for r in sized.filter(F.col("_part") == k).select(*words.columns).collect()]
        if rows:  # a long word may leave a part empty
            yield rows
    sized.unpersist()


def _automaton(words: list[tuple[str, object]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, value in words:
        a.add_word(word, (word, value))
    a.make_automaton()
    return a


def first_row(text: Column, table: DataFrame, key: str = "risk_factor_keyword", position: str = "position") -> Column:
    """The position of the first row whose keyword is in the lower-cased text; null where none is. Ties in position go to none in particular, so positions are to differ.

    The keywords become an automaton that finds all of them in one scan of a text, whatever their number; every task gets it.
    """
    words = table.select(F.lower(F.col(key)).alias("word"), F.col(position).cast("long").alias("position")).filter(F.col("word").isNotNull() & (F.col("word") != DEFAULT)).groupBy("word").agg(F.min("position").alias("position"))

    def least(part: list[tuple]) -> Column:
        def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            a = _automaton(part)
            for texts in batches:
                yield pd.Series([None if t is None else min((value for _, (_, value) in a.iter(t)), default=None) for t in texts], dtype="Int64")

        return F.pandas_udf(search, "long")(F.lower(text))

    found = [least(part) for part in _parts(words, [F.col("position"), F.col("word")])]
    if not found:
        return F.lit(None).cast("long")
    return found[0] if len(found) == 1 else F.least(*found)


def keyword_match(df: DataFrame, text: str, table: DataFrame, key: str = "risk_factor_keyword", position: str = "position", columns: tuple[str, ...] = ("intervention", "message", "cost")) -> DataFrame:
    """``df`` with ``keyword`` and ``columns`` of the table's first row whose keyword is in the lower-cased text, else of its row ``default``; null where the table has neither.

    A changed table changes the answers. A null text takes the default. Spark broadcasts the table if it is small.
    """
    hit = table.select(F.col(position).cast("long").alias("_at"), F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    other = hit.filter(F.lower("_key") == DEFAULT).groupBy().agg(*[F.min_by(c, "_at").alias(f"{c}_else") for c in ("_key", *[f"_{c}" for c in columns])])
    found = df.withColumn("_first", first_row(F.col(text), table, key, position)).join(hit, F.col("_first") == F.col("_at"), "left").crossJoin(F.broadcast(other))  # of one row
    names = {"keyword": "_key", **{c: f"_{c}" for c in columns}}
    found = found.withColumns({new: F.when(F.col("_first").isNull(), F.col(f"{old}_else")).otherwise(F.col(old)) for new, old in names.items()})
    return found.drop("_first", "_at", *[x for old in names.values() for x in (old, f"{old}_else")])


def key_words(key: Column) -> Column:
    """A key's words of more than three letters."""
    return F.filter(F.split(F.lower(key), "_"), lambda w: F.length(w) > 3)


def key_match(df: DataFrame, risk: str, table: DataFrame, key: str = "key", position: str = "position", columns: tuple[str, ...] = ("intervention_type",)) -> DataFrame:
    """``df`` with ``matched_key``, ``match_type`` and ``columns`` of a playbook of keys: the exact key (lower-cased, blanks and hyphens as underscores), else the key with most of its words in the text, ties to the
    first, else ``default``. Null columns where the playbook has no such key."""
    asked = df.withColumn("_q", F.translate(F.lower(F.col(risk)), " -", "__"))
    keys = table.select(F.col(position).cast("long").alias("_at"), F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    exact = keys.select(F.col("_key").alias("_exact")).distinct()
    words = keys.filter(F.col("_key") != DEFAULT).select("_at", F.col("_key"), F.explode(key_words(F.col("_key"))).alias("word")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("_at", "_key"))).alias("rows"))
    words = words.select("word", F.transform("rows", lambda r: r["_at"]).alias("at"), F.transform("rows", lambda r: r["_key"]).alias("keys"))
    parts = list(_parts(words, [F.col("word")]))
    if len(parts) > 1:
        raise ValueError("the playbook's words are too many to be counted in one scan")

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton([(w, list(zip(at, keys))) for w, at, keys in parts[0]])
        for texts in batches:
            out = []
            for t in texts:
                counts: dict[tuple[int, str], int] = {}
                for rows in {w: rows for _, (w, rows) in a.iter(t or "")}.values():  # each word once
                    for row in rows:
                        counts[row] = counts.get(row, 0) + 1
                top = min(((-n, at, k) for (at, k), n in counts.items()), default=None)
                out.append(None if top is None else top[2])
            yield pd.Series(out, dtype=object)

    fuzzy = F.pandas_udf(search, "string")(F.col("_q")) if parts else F.lit(None).cast("string")
    out = asked.withColumn("_fuzzy", fuzzy).join(exact, F.col("_q") == F.col("_exact"), "left")
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "fuzzy").otherwise(DEFAULT)
    out = out.withColumn("match_type", kind).withColumn("matched_key", F.coalesce("_exact", "_fuzzy", F.lit(DEFAULT))).drop("_q", "_fuzzy", "_exact")
    return out.join(keys.drop("_at"), F.col("matched_key") == F.col("_key"), "left").withColumns({c: F.col(f"_{c}") for c in columns}).drop("_key", *[f"_{c}" for c in columns])
