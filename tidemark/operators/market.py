"""The marketplace's six exported tables to features: payments and reviews brought to one row an order, people instead of order accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import features, validate

# The dates that part history from outcome, the fallback of an unknown way to pay, states of the first two tiers (all others are of tier 3).
CUTOFF, WINDOW_START, WINDOW_END = "2017-12-31", "2018-01-01", "2018-10-01"
PAYMENT = "credit_card"
TIER_1 = ["SP", "RJ"]
TIER_2 = ["MG", "RS", "PR", "BA", "DF"]


def enriched(tables: dict[str, DataFrame]) -> DataFrame:
    """Delivered orders of the tables of ``sources.tables.load_marketplace``, with ``customer_id`` as the person's lasting id."""
    state = F.col("customer_state")
    tier = F.when(state.isin(TIER_1), 1).when(state.isin(TIER_2), 2).otherwise(3)
    people = tables["customers"].select("customer_id", F.col("customer_unique_id").alias("person"), state.alias("state"), tier.alias("region"))
    orders = tables["orders"].filter(F.col("order_status") == "delivered").select("order_id", "customer_id", F.col("order_status").alias("status"), F.col("order_purchase_timestamp").cast("timestamp_ntz").alias("ts"))
    reviews = tables["reviews"].select("order_id", "review_id", "review_score", F.col("review_answer_timestamp").cast("timestamp_ntz").alias("answered_at"))
    items = tables["items"].select("order_id", "product_id", "seller_id", "price", F.col("freight_value").alias("freight"), F.lit(None).cast("int").alias("installment"), F.lit(0).alias("coupon"))
    products = tables["products"]
    category = F.col("product_category_name") if "product_category_name" in products.columns else F.lit(None).cast("string")
    out = features.orders_enriched(features.order_inputs(orders, tables["payments"], reviews), people, items, products.select("product_id", category.alias("category")))
    return out.drop("customer_id").withColumnRenamed("person", "customer_id")


def marketplace_features(tables: dict[str, DataFrame], cutoff: str = CUTOFF, window_start: str = WINDOW_START, window_end: str = WINDOW_END) -> DataFrame:
    """The common columns and composites of everybody with an order before the cutoff; without such orders an error.

    Items stand in for hours in the app, a voucher as the commonest way to pay for coupons.
    """
    history = features.customer_history(enriched(tables), cutoff, window_start, window_end, PAYMENT)
    history = validate.some_rows(history, "the history before the cutoff").withColumn("CouponLines", (F.col("PreferredPaymentMode") == "voucher").cast("long"))
    hours = history.select("customer_id", F.least("TotalItemCount", F.lit(10)).cast("double").alias("HourSpendOnApp"))
    rows = features.coded_categories(features.marketplace(history, hours, {1: 1, 2: 2}))
    return rows.withColumn("CustomerID", F.col("customer_id").cast("string")).drop("customer_id")
