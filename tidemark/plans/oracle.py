"""The same tables as common table expressions in SQL, for the oracle."""

from __future__ import annotations

from tidemark.functions.semantics import SEGMENTS
from tidemark.operators import features, scoring
from tidemark.plans.bind import TYPES


def _mode(group: str, column: str, table: str, default: str) -> str:
    """Most frequent non-null value of a column, ties to the smallest."""
    return f"SELECT {group}, {column} AS v FROM (SELECT {group}, {column}, row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {column}) AS k FROM {table} WHERE {column} IS NOT NULL GROUP BY {group}, {column}) WHERE k = 1"


def _sum(weights: dict[str, float], bias: float) -> str:
    out = f"{bias}::DOUBLE"
    for c, w in weights.items():
        out = f"({out} + {w}::DOUBLE * {c})"
    return out


ORDERS = f"""
lines AS (SELECT l.*, p_type FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey),
per_order AS (SELECT l_orderkey, count(*)::BIGINT AS item_count, sum(l_extendedprice) AS items_price, avg(l_extendedprice * l_tax) AS avg_freight,
  count(DISTINCT l_suppkey)::BIGINT AS distinct_sellers, max(l_linenumber)::DOUBLE AS avg_installments, sum((l_discount >= 0.09)::INT)::BIGINT AS coupon_lines FROM lines GROUP BY 1),
cat AS ({_mode("l_orderkey", "p_type", "lines", "other")}),
enriched AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ts, o_totalprice AS payment_value, o_orderpriority AS payment_type,
  coalesce(CAST(substr(o_orderpriority, 1, 1) AS INT), 3) AS review_score, n_name AS state, n_regionkey AS region, item_count, items_price, avg_freight, distinct_sellers, avg_installments, coupon_lines, coalesce(cat.v, 'other') AS dominant_category
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per_order ON o_orderkey = per_order.l_orderkey LEFT JOIN cat ON o_orderkey = cat.l_orderkey
  WHERE o_orderstatus <> 'P')"""

HISTORY = f"""{ORDERS},
hist AS (SELECT * FROM enriched WHERE ts < TIMESTAMP '2000-12-31'),
again AS (SELECT DISTINCT customer_id FROM enriched WHERE ts >= TIMESTAMP '2001-01-01' AND ts < TIMESTAMP '2001-08-02'),
pay AS ({_mode("customer_id", "payment_type", "hist", "")}), dom AS ({_mode("customer_id", "dominant_category", "hist", "")}),
agg AS (SELECT customer_id, count(DISTINCT order_id)::BIGINT AS OrderCount, min(ts) AS first_ts, max(ts) AS last_ts, avg(payment_value) AS AvgOrderValue, coalesce(sum(payment_value), 0) AS TotalSpend,
  avg(avg_freight) AS AvgFreightValue, avg(review_score) AS AvgReviewScore, sum((review_score <= 2)::INT)::BIGINT AS LowReviewCount, coalesce(sum(item_count), 0)::BIGINT AS TotalItemCount, avg(avg_installments) AS AvgInstallments,
  coalesce(sum(distinct_sellers), 0)::BIGINT AS DistinctSellers, coalesce(sum(coupon_lines), 0)::BIGINT AS CouponLines FROM hist GROUP BY 1),
st AS (SELECT customer_id, state, region FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts, order_id) AS k FROM hist WHERE state IS NOT NULL) WHERE k = 1),
history AS (SELECT agg.*, state AS CustomerState, region AS CustomerRegion, coalesce(pay.v, '3-MEDIUM') AS PreferredPaymentMode, coalesce(dom.v, 'other') AS PreferedOrderCat,
  CASE WHEN again.customer_id IS NULL THEN 1 ELSE 0 END AS Churn,
  greatest(1, floor((epoch(TIMESTAMP '2000-12-31') - epoch(first_ts)) / 86400))::DOUBLE AS Tenure, greatest(0, floor((epoch(TIMESTAMP '2000-12-31') - epoch(last_ts)) / 86400))::DOUBLE AS DaySinceLastOrder
  FROM agg LEFT JOIN st USING (customer_id) LEFT JOIN pay USING (customer_id) LEFT JOIN dom USING (customer_id) LEFT JOIN again USING (customer_id))"""

FEATURES = f"""{HISTORY},
hours AS (SELECT user_id AS customer_id, count(*)::DOUBLE AS h FROM events GROUP BY 1),
meds AS (SELECT median(AvgOrderValue) AS aov, median(AvgFreightValue) AS freight FROM history),
common0 AS (SELECT history.customer_id, Churn, Tenure, DaySinceLastOrder, OrderCount, PreferredPaymentMode, PreferedOrderCat, h,
  round(greatest(0, AvgOrderValue - aov) + 3.1e-9, 6) AS OrderAmountHikeFromlastYear, greatest(1, least(5, round_even(AvgReviewScore, 0)))::INT AS SatisfactionScore, (LowReviewCount > 0)::INT AS Complain,
  CASE CustomerRegion WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS CityTier, round(coalesce(AvgFreightValue, freight) + 3.1e-9, 6) AS WarehouseToHome, 1 AS NumberOfAddress,
  round(TotalSpend / greatest(OrderCount, 1) + 3.1e-9, 6) AS CashbackAmount, CouponLines::DOUBLE AS CouponUsed, greatest(1, least(5, DistinctSellers))::INT AS NumberOfDeviceRegistered
  FROM history CROSS JOIN meds LEFT JOIN hours USING (customer_id)),
common AS (SELECT *, coalesce(h, (SELECT median(h) FROM common0)) AS HourSpendOnApp FROM common0),
mx AS (SELECT max(HourSpendOnApp) AS mh, max(OrderCount) AS mo, max(DaySinceLastOrder) AS md, max(NumberOfDeviceRegistered) AS mdev, max(NumberOfAddress) AS madr, max(OrderAmountHikeFromlastYear) AS mhike, max(WarehouseToHome) AS mw FROM common),
features AS (SELECT customer_id::VARCHAR AS CustomerID, common.*, round(0.5 * (HourSpendOnApp / mh) + 0.5 * (OrderCount / mo::DOUBLE) + 3.1e-9, 6) AS EngagementScore, round(DaySinceLastOrder / CASE WHEN md > 0 THEN md ELSE 1 END + 3.1e-9, 6) AS RecencySignal,
  round((NumberOfDeviceRegistered + NumberOfAddress) / (mdev + madr)::DOUBLE + 3.1e-9, 6) AS StickinessIndex, round(OrderAmountHikeFromlastYear / (mhike + 1e-9) + 3.1e-9, 6) AS SpendTrend, round(0.6::DOUBLE * Complain + 0.4::DOUBLE * (SatisfactionScore - 1) / 4 + 3.1e-9, 6) AS SupportRiskScore,
  round(CouponUsed / (OrderCount + 1e-9) + 3.1e-9, 6) AS DiscountSensitivity, round(ln(1 + Tenure) + 3.1e-9, 6) AS TenureStability, round(WarehouseToHome / (mw + 1e-9) + 3.1e-9, 6) AS WarehouseFriction FROM common CROSS JOIN mx)"""

_D = [" + ".join(f"({c} - {m}::DOUBLE) * ({c} - {m}::DOUBLE)" for c, m in zip(scoring.CENTROID_COLUMNS, centre)) for centre in scoring.CENTROIDS]
_NEAR = "CASE " + " ".join(f"WHEN d{i} = least(d0, d1, d2, d3, d4) THEN {i}" for i in range(5)) + " END"
_LABEL = "CASE RawSegment " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENTS)) + " END"
_TOTAL = " + ".join(f"1 / ((d{i} + 0.01::DOUBLE) * (d{i} + 0.01::DOUBLE))" for i in range(5))
_SOFT = ", ".join(f"round((1 / ((d{i} + 0.01::DOUBLE) * (d{i} + 0.01::DOUBLE))) / ({_TOTAL}) + 3.1e-9, 6) AS GMM_Prob_Seg{i}" for i in range(5))

SCORED = f"""{FEATURES},
dist AS (SELECT *, {", ".join(f"round({d}, 9) AS d{i}" for i, d in enumerate(_D))} FROM features),
raw AS (SELECT *, {_NEAR} AS RawSegment, {_SOFT} FROM dist),
churned AS (SELECT *, {_LABEL} AS Segment, round(1 / (1 + exp(-({_sum(scoring.CHURN_WEIGHTS, scoring.CHURN_BIAS)}))) + 3.1e-9, 6) AS ChurnProbability, round({_sum(scoring.UPLIFT_WEIGHTS, scoring.UPLIFT_BIAS)} + 3.1e-9, 6) AS UpliftScore FROM raw),
typed AS (SELECT *, (ChurnProbability >= 0.5)::INT AS ChurnPrediction, CASE WHEN ChurnProbability <= 0.3 THEN 'Low Risk' WHEN ChurnProbability <= 0.6 THEN 'Medium Risk' WHEN ChurnProbability > 0.6 THEN 'High Risk' END AS RiskTier,
  (Complain = 1 OR CouponUsed > 0)::INT AS Treatment, CASE WHEN UpliftScore >= 0.05 AND ChurnProbability >= 0.3 THEN 'Persuadable' WHEN UpliftScore >= 0.05 THEN 'Sure Thing' WHEN ChurnProbability >= 0.3 THEN 'Lost Cause' ELSE 'Sleeping Dog' END AS CustomerType,
  round(UpliftScore * 500 + 3.1e-9, 6) AS ExpectedRetainedValue, 15.0::DOUBLE AS InterventionCost, round(round(UpliftScore * 500 + 3.1e-9, 6) - 15 + 3.1e-9, 6) AS NetROI FROM churned),
scored AS (SELECT *, NetROI > 0 AS ROIPositive, CASE WHEN CustomerType = 'Persuadable' THEN rank() OVER (PARTITION BY CustomerType ORDER BY NetROI DESC) + (count(*) OVER (PARTITION BY CustomerType, NetROI) - 1) / 2.0::DOUBLE END AS InterventionPriority FROM typed)"""

CUSTOMERS = f"""{SCORED},
customers AS (SELECT {", ".join(f"{a} AS {b}" for a, b in scoring.SERVED.items() if a not in ("UMAP_1", "UMAP_2", "TopDrivers"))} FROM scored)"""

_LONG = " UNION ALL ".join(f"SELECT CustomerID, Segment, {i} AS pos, '{c}' AS feature, {c}::DOUBLE AS x, {scoring.IMPORTANCE[c]}::DOUBLE AS imp FROM scored" for i, c in enumerate(features.CLUSTERING))
DRIVERS = f"""{SCORED},
long AS ({_LONG}),
mom AS (SELECT Segment, feature, avg(x) AS mu, coalesce(CASE WHEN stddev_samp(x) = 0 THEN 1 ELSE stddev_samp(x) END, 1) AS sd FROM long GROUP BY 1, 2),
wts AS (SELECT long.*, round(abs(x - mu) / sd * imp + 3.1e-7, 4) AS w, CASE WHEN round(x - mu, 9) > 0 THEN round(abs(x - mu) / sd * imp + 3.1e-7, 4) ELSE -round(abs(x - mu) / sd * imp + 3.1e-7, 4) END AS value FROM long JOIN mom USING (Segment, feature)),
drivers AS (SELECT CustomerID, Segment, feature, value, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY w DESC, pos) AS k FROM wts) WHERE k <= 5)"""

_IMP = " UNION ALL ".join(
    f"SELECT Segment, '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(Churn) > 0 THEN round(abs(corr({c}::DOUBLE, Churn::DOUBLE)) + 3.1e-7, 4) ELSE 0 END AS imp FROM scored GROUP BY 1" for c in features.CLUSTERING
)
SEGMENT_DRIVERS = DRIVERS.replace("mom AS (", f"imps AS ({_IMP}),\nmom AS (").replace("* imp + 3.1e-7", "* imps.imp + 3.1e-7").replace("JOIN mom USING (Segment, feature)", "JOIN mom USING (Segment, feature) JOIN imps USING (Segment, feature)")

AUDIT = f"""{CUSTOMERS},
acts0 AS (SELECT event_id AS id, user_id::VARCHAR AS customer_id, CASE WHEN event_id % 11 <> 0 THEN [{", ".join(f"'{t}'" for t in TYPES)}][coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) % 7 + 1] END AS intervention_type,
  ts AS generated_at, event_id % 8 = 0 AS agentic_mode FROM events WHERE event_id % 4 = 0),
acts AS (SELECT acts0.*, segment FROM acts0 LEFT JOIN customers USING (customer_id)),
fb AS (SELECT event_id AS id, event_id - event_id % 4 AS retention_action_id, CASE event_type WHEN 'purchase' THEN 'retained' WHEN 'error' THEN 'churned' ELSE 'pending' END AS outcome, ts AS logged_at
  FROM events WHERE event_id % 3 = 0 AND event_type IN ('purchase', 'error', 'signup')),
latest AS (SELECT retention_action_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY retention_action_id ORDER BY logged_at DESC, id DESC) AS k FROM fb) WHERE k = 1)"""


def select(base: str, body: str) -> str:
    return f"WITH {base}\n{body}"
