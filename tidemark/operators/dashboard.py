"""Aggregates over the serving table that dashboards ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import CLV, COST, js_round, steady
from tidemark.operators.ranks import quantiles
from tidemark.operators.scoring import confidence

HIGH, MEDIUM, LOW = "High Risk", "Medium Risk", "Low Risk"


def of_segment(customers: DataFrame, segment: str | None) -> DataFrame:
    return customers if segment is None else customers.filter(F.col("segment") == segment)


def _count_as_sum(p: Column) -> Column:
    """A conditional count that is null over no rows, as a SQL sum is."""
    return F.sum(F.when(p, 1).otherwise(0))


def r6avg(c: str) -> Column:
    return F.round(F.avg(c), 6)


def segment_summary(customers: DataFrame) -> DataFrame:
    top = confidence("gmm_prob_seg")
    share = lambda p: F.round(F.avg(F.when(p, 1.0).otherwise(0.0)), 6)
    return (
        customers.withColumn("top", top)
        .groupBy("segment")
        .agg(
            F.count("*").alias("customer_count"), r6avg("churn").alias("churn_rate"), r6avg("churn_probability").alias("avg_churn_prob"), share(F.col("risk_tier") == HIGH).alias("high_risk_pct"), share(F.col("customer_type") == "Persuadable").alias("persuadable_pct"),
            r6avg("tenure").alias("avg_tenure"), r6avg("satisfaction_score").alias("avg_satisfaction"), r6avg("days_since_last_order").alias("avg_days_since_order"), r6avg("hour_spend_on_app").alias("avg_hour_spend"), r6avg("cashback_amount").alias("avg_cashback"),
            _count_as_sum(F.col("top") >= 0.9).alias("gmm_high"), _count_as_sum((F.col("top") >= 0.8) & (F.col("top") < 0.9)).alias("gmm_medium"), _count_as_sum(F.col("top") < 0.8).alias("gmm_boundary"),
        )
        .orderBy(F.desc("customer_count"), "segment")
    )


def churn_kpis(customers: DataFrame, segment: str | None = None) -> DataFrame:
    return of_segment(customers, segment).agg(F.count("*").alias("total"), _count_as_sum(F.col("risk_tier") == HIGH).alias("high_risk"), r6avg("churn_probability").alias("avg_churn_prob"), F.sum("churn").alias("actual_churners"))


def histogram(customers: DataFrame, segment: str | None = None) -> DataFrame:
    """Ten buckets; the last takes 1 and, as ``least`` skips nulls, unknown probabilities."""
    bucket = F.least(F.floor(F.col("churn_probability") * 10).cast("int"), F.lit(9))
    return of_segment(customers, segment).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count")).orderBy("bucket")


def risk_summary(customers: DataFrame) -> DataFrame:
    return customers.groupBy("segment").agg(*[_count_as_sum(F.col("risk_tier") == t).alias(n) for t, n in ((HIGH, "high_risk"), (MEDIUM, "medium_risk"), (LOW, "low_risk"))]).orderBy("segment")


def risk_share(customers: DataFrame) -> DataFrame:
    r = risk_summary(customers)
    total = F.greatest(F.col("high_risk") + F.col("medium_risk") + F.col("low_risk"), F.lit(1))
    return r.select("segment", *[js_round(F.col(c) * 100 / total).cast("long").alias(f"{c}_pct") for c in ("high_risk", "medium_risk", "low_risk")])


def driver_summary(drivers: DataFrame, segment: str | None = None, top: int = 8) -> DataFrame:
    d = drivers if segment is None else drivers.filter(F.col("Segment") == segment)
    return d.select(F.explode("TopDrivers").alias("feature", "value")).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("avg_importance")).orderBy(F.desc("avg_importance"), "feature").limit(top)


def avg_churn(customers: DataFrame) -> DataFrame:
    return customers.groupBy("segment").agg(r6avg("churn_probability").alias("avg_churn_prob")).orderBy(F.desc_nulls_first("avg_churn_prob"))


def type_summary(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_type").agg(F.count("*").alias("count"), r6avg("uplift_score").alias("avg_uplift_score"), r6avg("net_roi").alias("avg_net_roi"), _count_as_sum(F.col("roi_positive")).alias("positive_roi_count"), r6avg("churn_probability").alias("avg_churn_prob")).orderBy(F.desc("count"))


def persuadables(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("customer_type") == "Persuadable")


def roi_by_segment(customers: DataFrame) -> DataFrame:
    return persuadables(customers).groupBy("segment").agg(r6avg("net_roi").alias("avg_roi"), F.count("*").alias("persuadable_count")).orderBy(F.desc_nulls_first("avg_roi"))


def persuadable_roi(customers: DataFrame) -> DataFrame:
    return persuadables(customers).groupBy("segment").agg(F.count("*").alias("customers"), F.round(F.avg("net_roi"), 2).alias("avg_roi"), F.round(F.sum("net_roi"), 2).alias("total_roi"))


def top_persuadables(customers: DataFrame, limit: int = 200) -> DataFrame:
    return persuadables(customers).orderBy(F.desc_nulls_first("net_roi"), "customer_id").limit(limit).select("customer_id", "segment", "churn_probability", "uplift_score", "net_roi", "intervention_priority")


def uplift_kpis(customers: DataFrame) -> DataFrame:
    p = F.col("customer_type") == "Persuadable"
    return customers.agg(_count_as_sum(p).alias("persuadable_count"), _count_as_sum(F.col("roi_positive")).alias("positive_roi_count"), r6avg("uplift_score").alias("avg_uplift_score"), F.round(F.sum(F.when(p & F.col("roi_positive"), F.col("net_roi")).otherwise(0.0)), 6).alias("total_roi_potential"))


def confidence_tiers(customers: DataFrame) -> DataFrame:
    top = confidence("gmm_prob_seg")
    tier = F.when(top >= 0.9, "High").when(top >= 0.8, "Medium").otherwise("Boundary")
    return customers.withColumn("tier", tier).groupBy("segment", "tier").agg(F.count("*").alias("count"))


def kpi_sidebar(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count("*").alias("customers"), F.count_distinct("segment").alias("segments"), F.count_if(F.col("customer_type") == "Persuadable").alias("persuadables"), F.count_if(F.col("risk_tier") == HIGH).alias("high_risk"))


def tier_by_segment(customers: DataFrame) -> DataFrame:
    return customers.groupBy("segment", "risk_tier").agg(F.count("*").alias("count"))


def risk_table(customers: DataFrame, segments: list[str], tiers: list[str], n: int = 50) -> DataFrame:
    rows = customers.filter(F.col("segment").isin(segments) & F.col("risk_tier").isin(tiers))
    return rows.orderBy(F.desc("churn_probability"), "customer_id").limit(n).select("customer_id", "segment", "risk_tier", "churn_probability", "tenure", "order_count", "days_since_last_order", "satisfaction_score", "complain", "cashback_amount")


def campaign(customers: DataFrame, clv: float = CLV, cost: float = COST) -> DataFrame:
    """What a campaign to all Persuadables would cost and keep."""
    c = persuadables(customers).agg(F.count("*").alias("targets"), F.coalesce(F.sum("uplift_score"), F.lit(0.0)).alias("u"))
    spend, value = F.col("targets") * cost, F.col("u") * clv
    return c.select("targets", spend.cast("double").alias("spend"), steady(value, 4).alias("retained_value"), steady(value - spend, 4).alias("net_roi"), steady(F.coalesce(F.try_divide(value - spend, spend) * 100, F.lit(0.0)), 4).alias("roi_pct"))


def priority_list(customers: DataFrame, clv: float, cost: float, n: int = 100) -> DataFrame:
    return persuadables(customers).withColumn("roi", F.round(F.col("uplift_score") * clv - cost, 6)).orderBy(F.desc("roi"), "customer_id").limit(n).select("customer_id", "segment", "roi")


def uplift_box(customers: DataFrame) -> DataFrame:
    """(segment, low, q1, median, q3, high) of the uplift, exact, one row for each segment."""
    got = quantiles(customers, ["uplift_score"], [0.0, 0.25, 0.5, 0.75, 1.0], by="segment")
    names = ["low", "q1", "median", "q3", "high"]
    rows = customers.sparkSession.createDataFrame([(g, *q) for (g, _), q in got.items()], "segment string, " + ", ".join(f"{n} double" for n in names))
    return rows.select("segment", *[F.round(n, 6).alias(n) for n in names])


def heatmap(profiles: DataFrame, columns: list[str]) -> DataFrame:
    return profiles.select("Segment", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "mean"))


def segment_kpis(customers: DataFrame, labels: list[str]) -> DataFrame:
    """(segment, customers, churn_rate) of a fixed list of labels; one without customers has zeros."""
    known = customers.groupBy("segment").agg(F.count("*").alias("customers"), F.avg("churn").alias("churn_rate"))
    every = customers.sparkSession.createDataFrame([(s,) for s in labels], "segment string")
    return every.join(known, "segment", "left").select("segment", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("churn_rate", F.lit(0.0)), 6).alias("churn_rate"))


def confidence_share(customers: DataFrame) -> DataFrame:
    """(segment, high_pct, medium_pct, boundary_pct, sure_share): tiers in whole percent of the segment, and the share of memberships of 0.8 or more."""
    top = F.greatest(*[F.coalesce(F.col(f"gmm_prob_seg{i}"), F.lit(0.0)) for i in range(5)])
    c = customers.withColumn("top", top).groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= 0.9).alias("high"), F.count_if((F.col("top") >= 0.8) & (F.col("top") < 0.9)).alias("medium"))
    pct = lambda x: F.floor(x * 100 / F.greatest("n", F.lit(1)) + 0.5)
    high, medium = F.col("high"), F.col("medium")
    return c.select("segment", pct(high).alias("high_pct"), pct(medium).alias("medium_pct"), pct(F.col("n") - high - medium).alias("boundary_pct"), F.round((high + medium) / F.col("n"), 6).alias("sure_share"))


def binned(df: DataFrame, column: str, bins: int, low: float, high: float, by: str | None = None, only: list[str] | None = None) -> DataFrame:
    """(by, bin, count): equal bins of a column's range, the last closed on both sides; values outside and unknown ones are left out. ``only``: values of ``by`` to take."""
    df = df.filter(F.col(by).isin(only)) if only else df
    rows = df.filter(F.col(column).between(low, high))
    b = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*([by] if by else []), b.alias("bin")).agg(F.count("*").alias("count"))


def scatter(customers: DataFrame, columns: list[str], limit: int = 5000) -> DataFrame:
    """The first rows by id with some columns and ``risk``: 1, 0.5 or 0 by tier."""
    risk = F.when(F.col("risk_tier") == "High Risk", 1.0).when(F.col("risk_tier") == "Medium Risk", 0.5).otherwise(0.0)
    return customers.orderBy("customer_id").limit(limit).select("customer_id", *columns, risk.alias("risk"))


def symmetric_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """(axis, bound): the largest absolute value of each column, for axes from -bound to bound."""
    return df.agg(*[F.max(F.abs(c)).alias(c) for c in columns]).unpivot([], columns, "axis", "bound")


def campaign_summary(actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """(total, retained, churned, pending, retained_pct, churned_pct, overall_rate) of the last outcomes; the rate is that of known outcomes, null without any."""
    from tidemark.operators import audit

    c = audit.with_latest(actions, feedback).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "retained").alias("retained"), F.count_if(F.col("outcome") == "churned").alias("churned"))
    pct = lambda a, b: F.floor(F.try_divide(F.col(a) * 100, b) + 0.5)
    known = F.col("retained") + F.col("churned")
    return c.select("total", "retained", "churned", (F.col("total") - known).alias("pending"), pct("retained", F.col("total")).alias("retained_pct"), pct("churned", F.col("total")).alias("churned_pct"), pct("retained", known).alias("overall_rate"))


def total_customers(summary: DataFrame) -> DataFrame:
    """(total): a fold over the segment summary."""
    return summary.agg(F.coalesce(F.sum("customer_count"), F.lit(0)).alias("total"))
