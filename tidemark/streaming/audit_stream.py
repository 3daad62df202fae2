"""An extension: the audit summary over growing action and feedback folders. The retention rules themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDBACK = T.StructType([T.StructField("id", T.LongType()), T.StructField("retention_action_id", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("logged_at", T.TimestampType())])


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).parquet(path)


def daily_outcomes(feedback: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, outcome, n): counts by day of logging; rows later than ``late`` are left out, and a closed day's state is dropped."""
    return feedback.withWatermark("logged_at", late).groupBy(F.window("logged_at", "1 day").alias("w"), "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "outcome", "n")
