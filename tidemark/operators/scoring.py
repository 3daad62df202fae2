"""From features to the serving table: segments, churn scores with drivers, uplift, quadrants and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import CLV, COST, SEGMENTS, customer_type, is_true, r6, risk_tier, steady
from tidemark.operators.features import CLUSTERING
from tidemark.operators.ranks import running

#: A scorecard stands in for trained models where results must be reproducible: fixed centroids and weights over the composites.
CENTROID_COLUMNS = ["EngagementScore", "RecencySignal", "SpendTrend", "SupportRiskScore"]
CENTROIDS = [(0.55, 0.05, 0.10, 0.65), (0.45, 0.10, 0.02, 0.35), (0.35, 0.20, 0.05, 0.90), (0.30, 0.15, 0.01, 0.60), (0.25, 0.50, 0.02, 0.55)]
CHURN_WEIGHTS = {"RecencySignal": 2.0, "SupportRiskScore": 1.5, "EngagementScore": -1.2, "DiscountSensitivity": 0.3}
CHURN_BIAS = -1.2
UPLIFT_WEIGHTS = {"SupportRiskScore": 0.12, "RecencySignal": -0.10, "EngagementScore": -0.08}
UPLIFT_BIAS = 0.03
IMPORTANCE = {c: round(1 - 0.05 * i, 2) for i, c in enumerate(CLUSTERING)}
# The serving table's column names.
SERVED = {
    "CustomerID": "customer_id", "Segment": "segment", "ChurnProbability": "churn_probability", "RiskTier": "risk_tier", "UpliftScore": "uplift_score",
    "CustomerType": "customer_type", "NetROI": "net_roi", "ROIPositive": "roi_positive", "InterventionPriority": "intervention_priority", "UMAP_1": "umap_1", "UMAP_2": "umap_2",
    "Tenure": "tenure", "SatisfactionScore": "satisfaction_score", "DaySinceLastOrder": "days_since_last_order", "HourSpendOnApp": "hour_spend_on_app", "Complain": "complain",
    "OrderCount": "order_count", "CashbackAmount": "cashback_amount", "Churn": "churn", "TopDrivers": "top_shap_features",
    **{f"GMM_Prob_Seg{i}": f"gmm_prob_seg{i}" for i in range(5)},
}


def linear(weights: dict[str, float], bias: float) -> Column:
    out = F.lit(bias)
    for c, w in weights.items():
        out = out + F.lit(w) * F.col(c)
    return out


def assign_segments(df: DataFrame) -> DataFrame:
    """Adds RawSegment (nearest centroid, ties to the first), Segment and soft memberships that fall with the fourth power of the distance."""
    columns = [F.col(c) for c in CENTROID_COLUMNS]
    d = [F.round(sum(((c - m) * (c - m) for c, m in zip(columns, centre)), F.lit(0.0)), 9) for centre in CENTROIDS]
    near = F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d)]))["i"]
    closeness = [1 / ((x + 0.01) * (x + 0.01)) for x in d]
    total = sum(closeness[1:], closeness[0])
    out = df.withColumn("RawSegment", near).withColumn("Segment", F.element_at(F.lit(SEGMENTS), F.col("RawSegment") + 1))
    return out.withColumns({f"GMM_Prob_Seg{i}": r6(c / total) for i, c in enumerate(closeness)})


def confidence(prefix: str = "GMM_Prob_Seg") -> Column:
    return F.greatest(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(5)])


def score(df: DataFrame) -> DataFrame:
    """Adds churn probability, prediction and tier, and uplift (control less treated: positive helps)."""
    p = r6(1 / (1 + F.exp(-linear(CHURN_WEIGHTS, CHURN_BIAS))))
    return (
        df.withColumn("ChurnProbability", p)
        .withColumn("ChurnPrediction", is_true(F.col("ChurnProbability") >= 0.5).cast("int"))
        .withColumn("RiskTier", risk_tier(F.col("ChurnProbability")))
        .withColumn("UpliftScore", r6(linear(UPLIFT_WEIGHTS, UPLIFT_BIAS)))
        .withColumn("Treatment", (is_true(F.col("Complain") == 1) | is_true(F.col("CouponUsed") > 0)).cast("int"))
        .withColumn("CustomerType", customer_type(F.col("UpliftScore"), F.col("ChurnProbability")))
    )


def intervention_roi(df: DataFrame, clv: float = CLV, cost: float = COST) -> DataFrame:
    """Adds expected value, net ROI, its sign, and a descending average-tie rank among Persuadables (null for others)."""
    df = df.withColumn("ExpectedRetainedValue", r6(F.col("UpliftScore") * clv)).withColumn("InterventionCost", F.lit(cost))
    df = df.withColumn("NetROI", r6(F.col("ExpectedRetainedValue") - F.col("InterventionCost"))).withColumn("ROIPositive", F.col("NetROI") > 0)
    # Ranks over the distinct ROI values and their counts, by ranges of them.
    persuadable = F.col("CustomerType") == "Persuadable"
    values = df.filter(persuadable).groupBy("NetROI").agg(F.count("*").alias("n"))
    ranks = running(values, [], [-F.col("NetROI")], {"before": F.col("n")}).select(F.col("NetROI").alias("_roi"), (F.col("before") + (F.col("n") + 1) / 2.0).alias("InterventionPriority"))
    return df.join(ranks, persuadable & (F.col("NetROI") == F.col("_roi")), "left").drop("_roi")


def segment_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per segment and feature the mean and the sample deviation (1 where it is 0 or undefined), wide."""
    one = lambda c: F.coalesce(F.when(F.stddev_samp(c) == 0, 1.0).otherwise(F.stddev_samp(c)), F.lit(1.0))
    return df.groupBy("Segment").agg(*[x for c in columns for x in (F.avg(c).alias(f"mu_{c}"), one(c).alias(f"sd_{c}"))])


def drivers_by_segment(df: DataFrame, importances: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(CustomerID, Segment, Drivers, TopDrivers) by each segment's own importances (Segment, feature, importance); segments without any are left out, unknown features weigh 0."""
    own = importances.groupBy("Segment").agg(*[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("importance"))), F.lit(0.0)).alias(f"imp_{c}") for c in columns])  # one row for each segment
    out = top_drivers(df.join(F.broadcast(own), "Segment"), columns, {c: F.col(f"imp_{c}") for c in columns}, n)
    return out.select("CustomerID", "Segment", "Drivers", "TopDrivers")


def correlation_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(Segment, feature, importance): how strongly a feature goes with churn in a segment, as the absolute correlation in four digits; 0 where either is constant."""
    x, y = (lambda c: F.col(c).cast("double")), F.col("Churn").cast("double")
    r = lambda c: F.try_divide(F.covar_pop(x(c), y), F.stddev_pop(F.when(y.isNotNull(), x(c))) * F.stddev_pop(F.when(x(c).isNotNull(), y)))
    c = df.groupBy("Segment").agg(*[F.coalesce(steady(F.abs(r(c)), 4), F.lit(0.0)).alias(c) for c in columns])
    return c.unpivot(["Segment"], columns, "feature", "importance")


def top_drivers(df: DataFrame, columns: list[str] = CLUSTERING, importance: dict[str, float | Column] = IMPORTANCE, n: int = 5) -> DataFrame:
    """Adds Drivers, the ``n`` features whose distance to the segment's mean, by importance, is largest (ties in feature order), signed; and TopDrivers, the same as a map."""
    out = df.join(F.broadcast(segment_moments(df, columns)), "Segment")  # one row for each segment: a shuffle would send each segment to one task

    def entry(i: int, c: str) -> Column:
        weight = F.coalesce(steady(F.abs(F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}") * importance.get(c, 0.0), 4), F.lit(0.0))
        signed = F.when(F.round(F.col(c) - F.col(f"mu_{c}"), 9) > 0, weight).otherwise(-weight)
        return F.struct((-weight).alias("w"), F.lit(i).alias("pos"), F.lit(c).alias("feature"), signed.alias("value"))

    best = F.slice(F.array_sort(F.array(*[entry(i, c) for i, c in enumerate(columns)])), 1, n)
    out = out.withColumn("Drivers", F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"))))
    return out.withColumn("TopDrivers", F.map_from_entries("Drivers")).drop(*[f"{p}_{c}" for c in columns for p in ("mu", "sd")])


def rank_labels(df: DataFrame) -> DataFrame:
    """(RawSegment, rank_score, label): cluster means ranked by a weighted profile; the labels go by rank."""
    m = df.groupBy("RawSegment").agg(*[F.avg(c).alias(c) for c in ("EngagementScore", "RecencySignal", "StickinessIndex", "SupportRiskScore")])
    s = r6(0.4 * F.col("EngagementScore") + 0.3 * (1 - F.col("RecencySignal")) + 0.2 * F.col("StickinessIndex") + 0.1 * (1 - F.col("SupportRiskScore")))
    nth = F.row_number().over(Window.orderBy(F.desc("rank_score"), "RawSegment"))  # over the clusters
    labels = F.lit(SEGMENTS)
    label = F.when(nth <= 5, F.element_at(labels, F.least(nth, F.lit(5)))).otherwise(F.concat(F.lit("Segment "), F.col("RawSegment").cast("string")))
    return m.withColumn("rank_score", s).withColumn("label", label).select("RawSegment", "rank_score", "label")


def segment_profiles(df: DataFrame) -> DataFrame:
    """Per segment the rounded means of nine columns, the count and the churn rate."""
    names = ["EngagementScore", "RecencySignal", "StickinessIndex", "SpendTrend", "SupportRiskScore", "Tenure", "OrderCount", "DaySinceLastOrder", "SatisfactionScore"]
    return df.groupBy("Segment").agg(*[F.round(F.avg(c), 3).alias(c) for c in names], F.count("*").alias("Count"), F.round(F.avg("Churn"), 3).alias("ChurnRate"))


def serving_table(df: DataFrame) -> DataFrame:
    """The customers table: renamed columns, those that are present."""
    return df.select(*[F.col(a).alias(b) for a, b in SERVED.items() if a in df.columns])
