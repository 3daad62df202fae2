"""The driver's tables as marketplace inputs, and the serving tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, scoring
from tidemark.sources.stage import staged
from tidemark.sources.tables import load

CUTOFF, WINDOW_START, WINDOW_END = "2000-12-31", "2001-01-01", "2001-08-02"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched orders."""
    o = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("payment_value"), F.col("o_orderpriority").alias("payment_type"), F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"),
    )
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"), F.col("n_regionkey").alias("region"))
    c = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("customer_id"), "state", "region")
    items = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight"), F.col("l_linenumber").alias("installment"), (F.col("l_discount") >= 0.09).cast("long").alias("coupon"),
    )
    products = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    return features.orders_enriched(o, c, items, products)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.customer_history(orders(spark, sf_dir), CUTOFF, WINDOW_START, WINDOW_END)


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        hours = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("customer_id")).agg(F.count("*").cast("double").alias("HourSpendOnApp"))
        return features.marketplace(history(spark, sf_dir), hours).withColumn("CustomerID", F.col("customer_id").cast("string"))

    return staged(spark, sf_dir, "features", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, segments, churn, uplift and ROI: one row for each customer with history."""
    return staged(spark, sf_dir, "scored", lambda: scoring.intervention_roi(scoring.score(scoring.assign_segments(customer_features(spark, sf_dir)))))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving table."""
    return staged(spark, sf_dir, "customers", lambda: scoring.serving_table(scored(spark, sf_dir)))


def with_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "drivers", lambda: scoring.top_drivers(scored(spark, sf_dir)))


TYPES = ["Discount Offer", "Loyalty Reward", "Personalized Content", "Proactive Support Call", "Reactivation Campaign", "Premium Upgrade", "Service Recovery"]


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event as a retention action; k of its properties gives the type, and every eleventh has none."""
    e = load(spark, sf_dir, "events").filter(F.col("event_id") % 4 == 0)
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)) % 7
    kind = F.when(F.col("event_id") % 11 != 0, F.element_at(F.lit(TYPES), k + 1))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("customer_id"), kind.alias("intervention_type"), F.col("ts").alias("generated_at"), (F.col("event_id") % 8 == 0).alias("agentic_mode"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter((F.col("event_id") % 3 == 0) & F.col("event_type").isin("purchase", "error", "signup"))
    outcome = F.when(F.col("event_type") == "purchase", "retained").when(F.col("event_type") == "error", "churned").otherwise("pending")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") - F.col("event_id") % 4).alias("retention_action_id"), outcome.alias("outcome"), F.col("ts").alias("logged_at"))
