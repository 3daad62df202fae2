"""The action and feedback logs: joins, summaries, and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import is_true


def latest_outcomes(feedback: DataFrame) -> DataFrame:
    """(retention_action_id, outcome): the last feedback of each action, by time, then id."""
    return feedback.groupBy("retention_action_id").agg(F.max_by("outcome", F.struct("logged_at", "id")).alias("outcome"))


def with_feedback(actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Actions with every feedback row of theirs: an action with several comes several times."""
    f = feedback.select(F.col("retention_action_id").alias("id"), F.col("id").alias("feedback_id"), "outcome")
    return actions.join(f, "id", "left")


def with_latest(actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Actions, one row each, with their last outcome or ``pending``."""
    f = latest_outcomes(feedback).withColumnRenamed("retention_action_id", "id")
    return actions.join(f, "id", "left").withColumn("has_feedback", F.col("outcome").isNotNull()).withColumn("outcome", F.coalesce("outcome", F.lit("pending")))


def summary(joined: DataFrame, by: str, has_feedback: str = "feedback_id") -> DataFrame:
    """Totals, feedback counts, retained counts and the share retained, by a column."""
    seen = F.count(has_feedback) if has_feedback == "feedback_id" else F.count_if(has_feedback)
    kept = F.count_if(is_true(F.col("outcome") == "retained"))
    out = joined.groupBy(by).agg(F.count("*").alias("total"), seen.alias("with_feedback"), kept.alias("retained"))
    return out.withColumn("retention_rate", F.round(F.try_divide("retained", "with_feedback"), 3))


def outcome_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("outcome").agg(F.count("*").alias("n"))


def audit_log(actions: DataFrame, feedback: DataFrame, limit: int = 200) -> DataFrame:
    """The latest actions with their outcome and a label of their mode."""
    mode = F.when(F.col("agentic_mode"), "Agentic").otherwise("Standard")
    return with_latest(actions, feedback).withColumn("mode", mode).orderBy(F.desc("generated_at"), F.desc("id")).limit(limit).select("id", "customer_id", "intervention_type", "generated_at", "outcome", "mode")


def newest_conversation(messages: DataFrame, conversation: str, session: str, time: str) -> DataFrame:
    """The messages of each session's newest conversation."""
    newest = messages.groupBy(session).agg(F.max(conversation).alias(conversation))
    return messages.join(newest, [session, conversation]).orderBy(session, time)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str = "updated_at") -> DataFrame:
    """Rows of both tables, one for each key: the new one, or else the latest."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc_nulls_last(version))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")


def insert_missing(old: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The seed rows whose key isn't there yet."""
    return seeds.join(old.select(key), key, "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate(df: DataFrame, path: str) -> None:
    df.limit(0).write.mode("overwrite").parquet(path)


def export_plans(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
