"""Append-only logs whose batches are written once."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.stage import files

BATCH = re.compile(r"[A-Za-z0-9_.-]+")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, cast to its types; missing ones are null, and a column that the log doesn't know is an error."""
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"the log has no column {', '.join(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append_once(df: DataFrame, path: str, batch: str | int, schema: T.StructType) -> bool:
    """Append ``df`` to the log as ``batch``; False, and nothing appended, if that batch is there already.

    The rows are written beside the log and the finished folder is then renamed to the batch's name, which fails if it exists. So a batch is in the log whole or not at all, and a retry adds nothing. The file
    system has to rename folders atomically.
    """
    if not BATCH.fullmatch(str(batch)):
        raise ValueError(f"a batch can't be called {batch!r}")
    spark = df.sparkSession
    p, fs = files(spark, path)
    rows, at, beside = typed(df, schema), p(f"{path}/batch={batch}"), p(f"{path}/_{uuid.uuid4().hex}")
    if fs.exists(at):
        return False
    rows.write.parquet(beside.toString())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(at), none)
    except Py4JJavaError:
        if not fs.exists(at):
            raise
        fs.delete(beside, True)  # another run was first
        return False
    return True


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a log, with the batch they came in; no rows where there is no log yet."""
    _, fs = files(spark, path)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    if not fs.exists(files(spark, path)[0](path)):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def stream_to_log(rows: DataFrame, path: str, schema: T.StructType, checkpoint: str, name: str = "stream"):
    """A writer that appends each micro-batch of a stream under its number, so a batch that is run again after a failure is no second one. Call ``start`` on it."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: append_once(df, path, f"{name}-{n}", schema) and None)
