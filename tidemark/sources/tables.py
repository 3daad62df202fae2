"""Readers: Parquet and CSV tables, the JSON playbook, and tables that may be missing."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# The file names a telecom folder may hold, in order of preference.
CSV_NAMES = ("cell2celltrain.csv", "Cell2CellTrain.csv", "CELL2CELLTRAIN.csv", "cell2cell_train.csv", "train.csv", "TRAIN.csv", "cell2cell.csv", "Cell2Cell.csv", "cell2cell_data.csv")

# The marketplace's tables and the files they come in.
MARKETPLACE = {
    "customers": "olist_customers_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "products": "olist_products_dataset.csv",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, with NaN as null in every floating column."""
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns]) if floats else df


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; names are stripped. With a schema nothing is inferred."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def pick_csv(names: list[str], candidates: tuple[str, ...] = CSV_NAMES) -> str:
    """The first known name, else the first CSV by name that is no holdout."""
    for c in candidates:
        if c in names:
            return c
    rest = sorted(n for n in names if n.lower().endswith(".csv") and "holdout" not in n.lower())
    if not rest:
        raise FileNotFoundError("no CSV file among " + ", ".join(names))
    return rest[0]


def load_playbook(spark: SparkSession, path: str) -> DataFrame:
    """(key, entry...) rows of a JSON object of playbook entries; no rows where the file is missing."""
    entry = T.StructType([T.StructField(c, T.StringType()) for c in ("intervention_type", "channel", "timing", "cost_tier", "success_rate", "rationale", "message_template")] + [T.StructField("matched_features", T.ArrayType(T.StringType()))])
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([T.StructField("key", T.StringType()), *entry.fields]))
    rows = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), entry))).alias("key", "e"))
    return rows.select("key", "e.*")


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows of its schema where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, or by its ending a CSV. A missing file is a ``FileNotFoundError``, one that can't be read a ``RuntimeError``."""
    try:
        return nan_to_null(load_csv(spark, path, schema) if path.lower().endswith(".csv") else spark.read.parquet(path))
    except (PySparkException, Py4JJavaError) as e:  # a job that fails while the schema is read comes as the latter
        if isinstance(e, PySparkException) and e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no table at {path}") from e
        raise RuntimeError(f"the table at {path} can't be read") from e


def load_marketplace(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The marketplace's six tables by name; an error for the first file that is missing."""
    return {name: read_table(spark, f"{folder}/{file}") for name, file in MARKETPLACE.items()}
