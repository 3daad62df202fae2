"""All retention queries and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.semantics import SEGMENTS, steady
from tidemark.operators import agent, audit, dashboard, features, learn, metrics, playbook, scoring, serving, validate
from tidemark.plans import bind, oracle, sql_functions
from tidemark.sources import logs
from tidemark.sources.stage import shared_dir, staged, upsert_stage
from tidemark.sources.tables import load, pick_csv, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, base: str | None = None, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = oracle.select(base, sql) if base else sql


def _on(table: Callable[[SparkSession, str], DataFrame], f: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir), *args, **kwargs)


def _log(f: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: f(bind.actions(spark, sf_dir), bind.feedback(spark, sf_dir), *args)


C, S = oracle.CUSTOMERS, oracle.SCORED

# ---------------------------------------------------------------- features

_order_columns = ["order_id", "customer_id", "state", "payment_type", "review_score", "item_count", "distinct_sellers", "avg_installments", "coupon_lines", "dominant_category"]
_add(
    "orders_enriched",
    lambda s, d: bind.orders(s, d).select(*_order_columns, steady(F.col("items_price"), 4).alias("items_price"), steady(F.col("avg_freight"), 6).alias("avg_freight")),
    oracle.ORDERS,
    f"SELECT {', '.join(_order_columns)}, round(items_price + 3.1e-7, 4) AS items_price, round(avg_freight + 3.1e-9, 6) AS avg_freight FROM enriched",
)
_agg = ["customer_id", "OrderCount", "LowReviewCount", "TotalItemCount", "DistinctSellers", "CouponLines", "CustomerState", "PreferredPaymentMode", "PreferedOrderCat", "Churn", "Tenure", "DaySinceLastOrder"]
_means = ["AvgOrderValue", "TotalSpend", "AvgReviewScore", "AvgInstallments"]
_add(
    "customer_agg",
    lambda s, d: bind.history(s, d).select(*_agg, *[steady(F.col(c), 4).alias(c) for c in _means]),
    oracle.HISTORY,
    f"SELECT {', '.join(_agg)}, {', '.join(f'round({c} + 3.1e-7, 4) AS {c}' for c in _means)} FROM history",
)
_feats = ["CustomerID", "Churn", *features.CHURN_NUMERIC, *features.COMPOSITES]
_add("customer_features", lambda s, d: bind.customer_features(s, d).select(*_feats), oracle.FEATURES, f"SELECT {', '.join(_feats)} FROM features")
_add(
    "impute_median",
    lambda s, d: features.impute_medians(load(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")), ["price"]),
    None,
    "SELECT o_orderkey, coalesce(p, (SELECT median(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) FROM orders)) AS price FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders)",
)
_add(
    "label_encode",
    lambda s, d: features.encode(load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("p_type")), ["p_type"]),
    None,
    "SELECT p_partkey, (dense_rank() OVER (ORDER BY coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_type END, 'nan')) - 1)::INT AS p_type FROM part",
)
_add(
    "missing_rates",
    lambda s, d: validate.missing_rates(load(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))).withColumn("missing_rate", F.round("missing_rate", 6)),
    None,
    "SELECT 'o_orderkey' AS \"column\", 0.0::DOUBLE AS missing_rate UNION ALL SELECT 'o_orderpriority', round(avg((o_orderkey % 5 = 0)::INT), 6) FROM orders",
)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.semantics import yes_no

    flag = F.concat(F.lit(" "), F.element_at(F.lit(["YES", "no", "True", "1", "0", "maybe"]), (F.col("c_custkey") % 6 + 1).cast("int")))
    return load(spark, sf_dir, "customer").select("c_custkey", yes_no(flag).alias("flag"))


def _income(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.semantics import first_digits

    text = F.when(F.col("c_custkey") % 4 == 0, "none").otherwise(F.concat(F.lit("grp "), F.col("c_custkey").cast("string"), F.lit("-9")))
    return load(spark, sf_dir, "customer").select("c_custkey", first_digits(text, 3.0).alias("income"))


def _rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.semantics import mapped

    return load(spark, sf_dir, "customer").select("c_custkey", mapped(F.element_at(F.lit([*features.RATINGS, "?"]), (F.col("c_custkey") % 8 + 1).cast("int")), features.RATINGS, 2).alias("rating"))


_add("yes_no_flags", _flags, None, "SELECT c_custkey, (lower(trim(' ' || ['YES','no','True','1','0','maybe'][c_custkey % 6 + 1])) IN ('1','yes','true'))::INT AS flag FROM customer")
_add("income_group_digits", _income, None, "SELECT c_custkey, coalesce(TRY_CAST(nullif(regexp_extract(CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE 'grp ' || c_custkey::VARCHAR || '-9' END, '(\\d+)', 1), '') AS DOUBLE), 3.0) AS income FROM customer")
_add("credit_ordinal", _rating, None, f"SELECT c_custkey, [{', '.join(str(v) for v in features.RATINGS.values())}, 2][c_custkey % 8 + 1]::INT AS rating FROM customer")

# ---------------------------------------------------------------- segments, scores, drivers

_gmm = [f"GMM_Prob_Seg{i}" for i in range(5)]
_add("segment_assign", lambda s, d: bind.scored(s, d).select("CustomerID", "RawSegment", "Segment", *_gmm), S, f"SELECT CustomerID, RawSegment, Segment, {', '.join(_gmm)} FROM scored")
_add(
    "segment_rank_labels",
    _on(bind.scored, scoring.rank_labels),
    S,
    "SELECT RawSegment, s AS rank_score, ['Champions','Loyal Customers','At-Risk','Price Sensitive','Lapsed'][row_number() OVER (ORDER BY s DESC, RawSegment)] AS label FROM (SELECT RawSegment, round(0.4::DOUBLE * avg(EngagementScore) + 0.3::DOUBLE * (1 - avg(RecencySignal)) + 0.2::DOUBLE * avg(StickinessIndex) + 0.1::DOUBLE * (1 - avg(SupportRiskScore)) + 3.1e-9, 6) AS s FROM scored GROUP BY 1)",
)
_prof = ["EngagementScore", "RecencySignal", "StickinessIndex", "SpendTrend", "SupportRiskScore", "Tenure", "OrderCount", "DaySinceLastOrder", "SatisfactionScore"]
_add("segment_profiles", _on(bind.scored, scoring.segment_profiles), S, f"SELECT Segment, {', '.join(f'round(avg({c}), 3) AS {c}' for c in _prof)}, count(*)::BIGINT AS Count, round(avg(Churn), 3) AS ChurnRate FROM scored GROUP BY 1")
_add(
    "segment_heatmap",
    lambda s, d: dashboard.heatmap(scoring.segment_profiles(bind.scored(s, d)), _prof),
    S,
    " UNION ALL ".join(f"SELECT Segment, '{c}' AS feature, round(avg({c}), 3) AS mean FROM scored GROUP BY 1" for c in _prof),
)
for _name, _cols in {
    "score_risk_tier": ["CustomerID", "ChurnProbability", "ChurnPrediction", "RiskTier"],
    "customer_type": ["CustomerID", "UpliftScore", "Treatment", "CustomerType"],
    "intervention_roi": ["CustomerID", "ExpectedRetainedValue", "InterventionCost", "NetROI", "ROIPositive"],
    "intervention_priority": ["CustomerID", "InterventionPriority"],
}.items():
    _add(_name, lambda s, d, c=_cols: bind.scored(s, d).select(*c), S, f"SELECT {', '.join(_cols)} FROM scored")


def _driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.with_drivers(spark, sf_dir).select("CustomerID", F.posexplode("Drivers").alias("pos", "d")).select("CustomerID", (F.col("pos") + 1).alias("rank"), "d.feature", "d.value")


_add("driver_top5", _driver_rows, oracle.DRIVERS, "SELECT CustomerID, rank, feature, value FROM drivers")

def _segment_driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.scored(spark, sf_dir)
    own = scoring.drivers_by_segment(rows, scoring.correlation_importance(rows, features.CLUSTERING), features.CLUSTERING)
    return own.select("CustomerID", F.posexplode("Drivers").alias("pos", "d")).select("CustomerID", (F.col("pos") + 1).alias("rank"), "d.feature", "d.value")


_add("segment_drivers", _segment_driver_rows, oracle.SEGMENT_DRIVERS, "SELECT CustomerID, rank, feature, value FROM drivers")
_add(
    "ordered_targets",
    lambda s, d: learn.ordered_targets(bind.scored(s, d).select("CustomerID", "customer_id", F.when(F.col("customer_id") % 5 != 0, F.col("Churn")).alias("Churn"), "PreferredPaymentMode", "PreferedOrderCat"), ["PreferredPaymentMode", "PreferedOrderCat"], order=F.col("customer_id"))
    .select("CustomerID", *[steady(F.col(c), 6).alias(c) for c in ("PreferredPaymentMode", "PreferedOrderCat")]),
    f"{S}, t AS (SELECT CustomerID, customer_id, CASE WHEN customer_id % 5 <> 0 THEN Churn END AS y, PreferredPaymentMode AS a, PreferedOrderCat AS b, avg(CASE WHEN customer_id % 5 <> 0 THEN Churn END) OVER () AS r FROM scored)",
    "SELECT CustomerID, "
    + ", ".join(
        f"round((coalesce(sum(y) OVER w{k}, 0) + r) / (count(y) OVER w{k} + 1) + 3.1e-9, 6) AS {c}" for k, c in (("a", "PreferredPaymentMode"), ("b", "PreferedOrderCat"))
    )
    + " FROM t WINDOW "
    + ", ".join(f"w{k} AS (PARTITION BY {k} ORDER BY y IS NULL, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for k in "ab"),
)

# ---------------------------------------------------------------- aggregates over the serving table

_top = "greatest(coalesce(gmm_prob_seg0,0),coalesce(gmm_prob_seg1,0),coalesce(gmm_prob_seg2,0),coalesce(gmm_prob_seg3,0),coalesce(gmm_prob_seg4,0))"
_add(
    "rpc_segment_summary",
    _on(bind.customers, dashboard.segment_summary),
    C,
    f"""SELECT segment, count(*)::BIGINT AS customer_count, round(avg(churn), 6) AS churn_rate, round(avg(churn_probability), 6) AS avg_churn_prob, round(avg((risk_tier = 'High Risk')::INT), 6) AS high_risk_pct,
  round(avg((customer_type = 'Persuadable')::INT), 6) AS persuadable_pct, round(avg(tenure), 6) AS avg_tenure, round(avg(satisfaction_score), 6) AS avg_satisfaction, round(avg(days_since_last_order), 6) AS avg_days_since_order,
  round(avg(hour_spend_on_app), 6) AS avg_hour_spend, round(avg(cashback_amount), 6) AS avg_cashback, sum(({_top} >= 0.9)::INT)::BIGINT AS gmm_high, sum(({_top} >= 0.8 AND {_top} < 0.9)::INT)::BIGINT AS gmm_medium, sum(({_top} < 0.8)::INT)::BIGINT AS gmm_boundary
FROM customers GROUP BY segment""",
)
_kpis = "SELECT count(*)::BIGINT AS total, sum((risk_tier = 'High Risk')::INT)::BIGINT AS high_risk, round(avg(churn_probability), 6) AS avg_churn_prob, sum(churn)::BIGINT AS actual_churners FROM customers"
_hist = "SELECT least(floor(churn_probability * 10)::INT, 9) AS bucket, count(*)::BIGINT AS count FROM customers{} GROUP BY 1"
_add("rpc_churn_kpis", _on(bind.customers, dashboard.churn_kpis), C, _kpis)
_add("rpc_churn_kpis_segment", _on(bind.customers, dashboard.churn_kpis, "Lapsed"), C, _kpis + " WHERE segment = 'Lapsed'")
_add("rpc_churn_histogram", _on(bind.customers, dashboard.histogram), C, _hist.format(""))
_add("rpc_churn_histogram_segment", _on(bind.customers, dashboard.histogram, "At-Risk"), C, _hist.format(" WHERE segment = 'At-Risk'"))
_risk = "SELECT segment, sum((risk_tier = 'High Risk')::INT)::BIGINT AS high_risk, sum((risk_tier = 'Medium Risk')::INT)::BIGINT AS medium_risk, sum((risk_tier = 'Low Risk')::INT)::BIGINT AS low_risk FROM customers GROUP BY 1"
_add("rpc_risk_summary", _on(bind.customers, dashboard.risk_summary), C, _risk)
_shap = "SELECT feature, round(avg(abs(value)), 6) AS avg_importance FROM drivers{} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"
_add("rpc_shap_summary", _on(bind.with_drivers, dashboard.driver_summary), oracle.DRIVERS, _shap.format(""))
_add("rpc_shap_summary_segment", _on(bind.with_drivers, dashboard.driver_summary, "At-Risk"), oracle.DRIVERS, _shap.format(" WHERE Segment = 'At-Risk'"))
_add("rpc_avg_churn_by_segment", _on(bind.customers, dashboard.avg_churn), C, "SELECT segment, round(avg(churn_probability), 6) AS avg_churn_prob FROM customers GROUP BY 1")
_add(
    "rpc_customer_type_summary",
    _on(bind.customers, dashboard.type_summary),
    C,
    "SELECT customer_type, count(*)::BIGINT AS count, round(avg(uplift_score), 6) AS avg_uplift_score, round(avg(net_roi), 6) AS avg_net_roi, sum(roi_positive::INT)::BIGINT AS positive_roi_count, round(avg(churn_probability), 6) AS avg_churn_prob FROM customers GROUP BY 1",
)
_P = "FROM customers WHERE customer_type = 'Persuadable'"
_add("rpc_roi_by_segment", _on(bind.customers, dashboard.roi_by_segment), C, f"SELECT segment, round(avg(net_roi), 6) AS avg_roi, count(*)::BIGINT AS persuadable_count {_P} GROUP BY 1")
_add("rpc_top_persuadables", _on(bind.customers, dashboard.top_persuadables), C, f"SELECT customer_id, segment, churn_probability, uplift_score, net_roi, intervention_priority {_P} ORDER BY net_roi DESC, customer_id LIMIT 200")
_add(
    "rpc_uplift_kpis",
    _on(bind.customers, dashboard.uplift_kpis),
    C,
    "SELECT sum((customer_type = 'Persuadable')::INT)::BIGINT AS persuadable_count, sum(roi_positive::INT)::BIGINT AS positive_roi_count, round(avg(uplift_score), 6) AS avg_uplift_score, round(sum(CASE WHEN customer_type = 'Persuadable' AND roi_positive THEN net_roi ELSE 0 END), 6) AS total_roi_potential FROM customers",
)

# ---------------------------------------------------------------- dashboards

_add("confidence_tiers", _on(bind.customers, dashboard.confidence_tiers), C, f"SELECT segment, CASE WHEN {_top} >= 0.9 THEN 'High' WHEN {_top} >= 0.8 THEN 'Medium' ELSE 'Boundary' END AS tier, count(*)::BIGINT AS count FROM customers GROUP BY 1, 2")
_add("kpi_sidebar", _on(bind.customers, dashboard.kpi_sidebar), C, "SELECT count(*)::BIGINT AS customers, count(DISTINCT segment)::BIGINT AS segments, sum((customer_type = 'Persuadable')::INT)::BIGINT AS persuadables, sum((risk_tier = 'High Risk')::INT)::BIGINT AS high_risk FROM customers")
_add("risk_by_segment", _on(bind.customers, dashboard.tier_by_segment), C, "SELECT segment, risk_tier, count(*)::BIGINT AS count FROM customers GROUP BY 1, 2")
_pct = ", ".join(f"floor({c} * 100 / greatest(high_risk + medium_risk + low_risk, 1)::DOUBLE + 0.5)::BIGINT AS {c}_pct" for c in ("high_risk", "medium_risk", "low_risk"))
_add("risk_share_pct", _on(bind.customers, dashboard.risk_share), C, f"SELECT segment, {_pct} FROM ({_risk})")
_add(
    "risk_table",
    _on(bind.customers, dashboard.risk_table, ["At-Risk", "Lapsed"], ["High Risk", "Medium Risk"]),
    C,
    "SELECT customer_id, segment, risk_tier, churn_probability, tenure, order_count, days_since_last_order, satisfaction_score, complain, cashback_amount FROM customers WHERE segment IN ('At-Risk', 'Lapsed') AND risk_tier IN ('High Risk', 'Medium Risk') ORDER BY churn_probability DESC, customer_id LIMIT 50",
)
_add(
    "campaign_whatif",
    _on(bind.customers, dashboard.campaign, 800.0, 20.0),
    C,
    f"SELECT n::BIGINT AS targets, n * 20.0::DOUBLE AS spend, round(u * 800 + 3.1e-7, 4) AS retained_value, round(u * 800 - n * 20 + 3.1e-7, 4) AS net_roi, round(coalesce((u * 800 - n * 20) / nullif(n * 20, 0) * 100, 0) + 3.1e-7, 4) AS roi_pct FROM (SELECT count(*) AS n, coalesce(sum(uplift_score), 0) AS u {_P})",
)
_add("persuadable_roi_by_segment", _on(bind.customers, dashboard.persuadable_roi), C, f"SELECT segment, count(*)::BIGINT AS customers, round(avg(net_roi), 2) AS avg_roi, round(sum(net_roi), 2) AS total_roi {_P} GROUP BY 1")
_add("priority_list", _on(bind.customers, dashboard.priority_list, 800.0, 20.0), C, f"SELECT customer_id, segment, round(uplift_score * 800 - 20, 6) AS roi {_P} ORDER BY roi DESC, customer_id LIMIT 100")
_quant = ", ".join(f"round(quantile_cont(uplift_score, {q}), 6) AS {n}" for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high")))
_add("uplift_box", _on(bind.customers, dashboard.uplift_box), C, f"SELECT segment, {_quant} FROM customers GROUP BY 1")

# ---------------------------------------------------------------- tools

_add(
    "tool_lookup",
    _on(bind.customers, agent.lookup, "42"),
    C,
    "SELECT customer_id, segment, risk_tier, customer_type, round_even(churn_probability, 3) AS churn_probability, round_even(uplift_score, 3) AS uplift_score, round_even(net_roi, 2) AS net_roi, tenure::BIGINT AS tenure, satisfaction_score::BIGINT AS satisfaction_score, complain > 0 AS complained, round_even(hour_spend_on_app, 1) AS hours_on_app, days_since_last_order::BIGINT AS days_since_last_order, order_count::BIGINT AS orders, round_even(cashback_amount, 2) AS cashback, churn > 0 AS churned FROM customers WHERE customer_id = '42'",
)
_add(
    "tool_lookup_coupons",
    lambda s, d: agent.lookup(bind.customers(s, d).join(bind.scored(s, d).select(F.col("CustomerID").alias("customer_id"), F.col("CouponUsed").alias("coupon_used")), "customer_id"), "7").select("customer_id", "segment", "orders", "coupons_used"),
    C,
    "SELECT c.customer_id, c.segment, order_count::BIGINT AS orders, CouponUsed::BIGINT AS coupons_used FROM customers c JOIN scored ON CustomerID = c.customer_id WHERE c.customer_id = '7'",
)
_add(
    "tool_segment_benchmark",
    _on(bind.customers, agent.segment_benchmark, "At-Risk"),
    C,
    "SELECT segment, count(*)::BIGINT AS customers, round(avg(churn), 3) AS churn_rate, round(avg(churn_probability), 3) AS avg_churn_probability, round(avg(uplift_score), 3) AS avg_uplift, round(avg((risk_tier = 'High Risk')::INT), 3) AS pct_high_risk, round(avg((customer_type = 'Persuadable')::INT), 3) AS pct_persuadable, round(avg(tenure), 1) AS avg_tenure, round(avg(satisfaction_score), 2) AS avg_satisfaction, round(avg(days_since_last_order), 1) AS avg_days_since_last_order, round(avg(hour_spend_on_app), 1) AS avg_hours_on_app, round(avg(complain), 3) AS complaint_rate FROM customers WHERE segment = 'At-Risk' GROUP BY 1",
)
_add(
    "tool_segment_benchmark_web",
    _on(bind.customers, agent.segment_benchmark_web, "At-Risk"),
    C,
    "SELECT segment, count(*)::BIGINT AS total, floor(avg(coalesce(churn_probability, 0)) * 100 + 0.5)::BIGINT AS avg_churn_pct, round(avg(coalesce(uplift_score, 0)), 4) AS avg_uplift, sum((risk_tier = 'High Risk')::INT)::BIGINT AS high_risk, sum((customer_type = 'Persuadable')::INT)::BIGINT AS persuadable FROM customers WHERE segment = 'At-Risk' GROUP BY 1",
)
_add(
    "tool_churn_drivers",
    _on(bind.with_drivers, agent.churn_drivers, "42"),
    oracle.DRIVERS,
    "SELECT feature, value, CASE WHEN value > 0 THEN 'increases churn risk' ELSE 'decreases churn risk' END AS effect, CASE WHEN abs(value) > 0.1 THEN 'strong' WHEN abs(value) > 0.05 THEN 'moderate' ELSE 'weak' END AS magnitude FROM drivers WHERE CustomerID = '42'",
)
_add(
    "tool_intervention_roi",
    lambda s, d: agent.roi(bind.customers(s, d), F.col("uplift_score")),
    C,
    "SELECT customer_id, round(uplift_score * 500 + 3.1e-5, 2) AS expected_value, round(uplift_score * 500 - 15 + 3.1e-5, 2) AS net_roi, round((uplift_score * 500 - 15) / 15 * 100 + 3.1e-4, 1) AS roi_pct, 0.03::DOUBLE AS break_even_uplift, CASE WHEN uplift_score * 500 - 15 > 0 THEN 'positive' ELSE 'negative' END AS verdict FROM customers",
)
_qsql = "SELECT CustomerID, rank, CASE WHEN value > 0 THEN 'high ' ELSE 'low ' END || feature AS risk FROM drivers"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk factors of all customers: their drivers in words."""
    each = bind.with_drivers(spark, sf_dir).select("CustomerID", F.posexplode("Drivers").alias("pos", "d"))
    return each.select("CustomerID", (F.col("pos") + 1).alias("rank"), F.concat(F.when(F.col("d.value") > 0, "high ").otherwise("low "), F.col("d.feature")).alias("risk"))


def _book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(agent.PLAYBOOK)], "position int, key string, intervention_type string")


_vals = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(agent.PLAYBOOK))
_words = ", ".join(f"('{k}', '{w}')" for k, _ in agent.PLAYBOOK if k != "default" for w in k.split("_") if len(w) > 3)
_add(
    "tool_playbook_exact_fuzzy",
    lambda s, d: playbook.key_match(_asked(s, d), "risk", _book(s)),
    f"{oracle.DRIVERS}, asked AS (SELECT *, replace(replace(lower(risk), ' ', '_'), '-', '_') AS q FROM ({_qsql})), book(i, k, v) AS (VALUES {_vals}), words(k, w) AS (VALUES {_words}), hits AS (SELECT CustomerID, rank, i, book.k, count(*) AS n FROM asked JOIN words ON contains(q, w) JOIN book ON book.k = words.k GROUP BY 1, 2, 3, 4), best AS (SELECT CustomerID, rank, k FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID, rank ORDER BY n DESC, i) AS r FROM hits) WHERE r = 1), m AS (SELECT asked.CustomerID, asked.rank, risk, coalesce(e.k, best.k, 'default') AS matched_key, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN best.k IS NOT NULL THEN 'fuzzy' ELSE 'default' END AS match_type FROM asked LEFT JOIN book e ON e.k = q LEFT JOIN best ON best.CustomerID = asked.CustomerID AND best.rank = asked.rank)",
    "SELECT CustomerID, rank, risk, matched_key, match_type, v AS intervention_type FROM m JOIN book ON k = matched_key",
)
_case = "CASE " + " ".join(f"WHEN contains(lower(risk), '{k}') THEN '{k}'" for k, _ in agent.KEYWORDS if k != "default") + " ELSE 'default' END"
_kv = "CASE keyword " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in agent.KEYWORDS) + " END"
_add(
    "tool_playbook_table",
    lambda s, d: playbook.keyword_match(_asked(s, d), "risk", playbook.seeds(s), columns=("intervention",)).withColumnRenamed("intervention", "intervention_type"),
    oracle.DRIVERS,
    f"SELECT *, {_kv} AS intervention_type FROM (SELECT *, {_case} AS keyword FROM ({_qsql}))",
)


def _benchmark_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playbook with a row for each benchmark item: its keyword is the item's third word."""
    word = F.lower(F.split_part("text", F.lit(" "), F.lit(3)))
    kind = F.element_at(F.lit(bind.TYPES), (F.col("item_id") % 7 + 1).cast("int"))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), word.alias("risk_factor_keyword"), kind.alias("intervention"))


_add(
    "tool_playbook_documents",
    lambda s, d: playbook.keyword_match(load(s, d, "documents").select("doc_id", "text"), "text", _benchmark_book(s, d), columns=("intervention",)).drop("text"),
    None,
    f"WITH book AS (SELECT item_id, lower(split_part(text, ' ', 3)) AS w, [{', '.join(repr(t) for t in bind.TYPES)}][item_id % 7 + 1] AS v FROM benchmark), "
    "m AS (SELECT doc_id, min(item_id) AS item_id FROM documents JOIN book ON w <> '' AND w <> 'default' AND contains(lower(text), w) GROUP BY 1) "
    "SELECT doc_id, w AS keyword, v AS intervention FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN book USING (item_id)",
)
_add(
    "tool_list_customers",
    _on(bind.customers, agent.list_customers, None, "High Risk", None, 30),
    C,
    "SELECT customer_id, segment, risk_tier, customer_type, round_even(churn_probability, 3) AS churn_probability, (SELECT count(*) FROM customers WHERE risk_tier = 'High Risk')::BIGINT AS total_matching FROM customers WHERE risk_tier = 'High Risk' ORDER BY customers.churn_probability DESC, customer_id LIMIT 20",
)
_add(
    "tool_all_benchmarks",
    lambda s, d: dashboard.segment_summary(bind.customers(s, d)).select("segment", "customer_count", "churn_rate", "avg_churn_prob", "high_risk_pct", "persuadable_pct"),
    C,
    "SELECT segment, count(*)::BIGINT AS customer_count, round(avg(churn), 6) AS churn_rate, round(avg(churn_probability), 6) AS avg_churn_prob, round(avg((risk_tier = 'High Risk')::INT), 6) AS high_risk_pct, round(avg((customer_type = 'Persuadable')::INT), 6) AS persuadable_pct FROM customers GROUP BY 1",
)
_add(
    "tool_past_interventions",
    _log(agent.past_interventions, "3"),
    oracle.AUDIT,
    "SELECT a.id, intervention_type, generated_at, coalesce(outcome, 'pending') AS outcome FROM (SELECT * FROM acts WHERE customer_id = '3' ORDER BY generated_at DESC, id DESC LIMIT 10) a LEFT JOIN latest ON retention_action_id = a.id",
)
_lastwins = "SELECT coalesce({0}, 'Unknown') AS {0}, count(*)::BIGINT AS total, count(outcome)::BIGINT AS with_feedback, coalesce(sum((outcome = 'retained')::INT), 0)::BIGINT AS retained, round(coalesce(sum((outcome = 'retained')::INT), 0) / nullif(count(outcome), 0)::DOUBLE, 3) AS retention_rate FROM acts LEFT JOIN latest ON retention_action_id = acts.id GROUP BY 1"
_add("tool_success_rates", _log(agent.success_rates), oracle.AUDIT, _lastwins.format("intervention_type"))
_add("tool_at_risk", _on(bind.customers, agent.at_risk), C, "SELECT customer_id, segment, churn_probability, net_roi FROM customers WHERE risk_tier = 'High Risk' ORDER BY churn_probability DESC NULLS FIRST, customer_id LIMIT 10")
_add("tool_revenue_at_risk", _on(bind.customers, agent.revenue_at_risk), C, "SELECT sum(e)::BIGINT AS expected_churners, sum(e * 500.0::DOUBLE) AS revenue_at_risk FROM (SELECT floor(count(*) * round(avg(churn_probability), 9) + 0.5)::BIGINT AS e FROM customers GROUP BY segment)")
_add(
    "tool_unactioned_persuadables",
    lambda s, d: agent.unactioned_persuadables(bind.customers(s, d), bind.actions(s, d)),
    oracle.AUDIT,
    f"SELECT customer_id, segment, net_roi FROM (SELECT * {_P} ORDER BY net_roi DESC NULLS FIRST, customer_id LIMIT 100) b WHERE customer_id NOT IN (SELECT customer_id FROM acts) ORDER BY net_roi DESC NULLS FIRST, customer_id LIMIT 10",
)
_add(
    "prompts",
    _on(bind.customers, agent.prompt),
    C,
    "SELECT customer_id, printf('Customer %s (%s, %s). Churn probability %.1f%%, uplift %.4f, net ROI $%.2f. Tenure %.0f, orders %d, days since last order %.0f, satisfaction %d of 5.', customer_id, segment, customer_type, round(churn_probability * 100 + 3.1e-4, 1), round(uplift_score + 3.1e-7, 4), round(net_roi + 3.1e-5, 2), tenure, order_count, days_since_last_order, satisfaction_score) AS prompt FROM customers",
)

# ---------------------------------------------------------------- audit


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bind.customers(spark, sf_dir).select("customer_id", "segment")
    return audit.with_feedback(bind.actions(spark, sf_dir).join(c, "customer_id", "left"), bind.feedback(spark, sf_dir))


_fan = "SELECT {0}, count(*)::BIGINT AS total, count(fb.id)::BIGINT AS with_feedback, coalesce(sum((outcome = 'retained')::INT), 0)::BIGINT AS retained, round(coalesce(sum((outcome = 'retained')::INT), 0) / nullif(count(fb.id), 0)::DOUBLE, 3) AS retention_rate FROM acts LEFT JOIN fb ON retention_action_id = acts.id {1} GROUP BY 1"
_add("audit_summary_by_type", lambda s, d: audit.summary(audit.with_feedback(bind.actions(s, d), bind.feedback(s, d)), "intervention_type"), oracle.AUDIT, _fan.format("intervention_type", ""))
_add("audit_summary_by_segment", lambda s, d: audit.summary(_segmented(s, d).filter(F.col("segment").isNotNull()), "segment"), oracle.AUDIT, _fan.format("segment", "WHERE segment IS NOT NULL"))
_add("audit_outcomes", lambda s, d: audit.outcome_counts(bind.feedback(s, d)), oracle.AUDIT, "SELECT outcome, count(*)::BIGINT AS n FROM fb GROUP BY 1")
_add("audit_latest_by_type", _log(agent.success_rates), oracle.AUDIT, _lastwins.format("intervention_type"))
_add(
    "audit_log",
    _log(audit.audit_log),
    oracle.AUDIT,
    "SELECT acts.id, customer_id, intervention_type, generated_at, coalesce(outcome, 'pending') AS outcome, CASE WHEN agentic_mode THEN 'Agentic' ELSE 'Standard' END AS mode FROM acts LEFT JOIN latest ON retention_action_id = acts.id ORDER BY generated_at DESC, acts.id DESC LIMIT 200",
)


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant")).withColumn("session", F.col("conv_id") % 7)
    return audit.newest_conversation(m, "conv_id", "session", "turn").select("session", "conv_id", "turn", "role", "text")


_add("chat_history_latest", _chat, None, "WITH m AS (SELECT *, conv_id % 7 AS session FROM conversations WHERE role IN ('user', 'assistant')), n AS (SELECT session, max(conv_id) AS c FROM m GROUP BY 1) SELECT m.session, conv_id, turn, role, text FROM m JOIN n ON m.session = n.session AND conv_id = c")

# ---------------------------------------------------------------- statistics and learned models

_add(
    "ari",
    lambda s, d: metrics.adjusted_rand(bind.scored(s, d), "Segment", "CustomerType"),
    S,
    "SELECT round(CASE WHEN (r + c) / 2 - r * c / n2 = 0 THEN 1 ELSE (x - r * c / n2) / ((r + c) / 2 - r * c / n2) END, 6) AS ari FROM (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS x FROM (SELECT count(*) AS n FROM scored GROUP BY Segment, CustomerType)), (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS r FROM (SELECT count(*) AS n FROM scored GROUP BY Segment)), (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS c FROM (SELECT count(*) AS n FROM scored GROUP BY CustomerType)), (SELECT count(*) * (count(*) - 1) / 2.0::DOUBLE AS n2 FROM scored)",
)
_add(
    "auc_ap_brier",
    lambda s, d: metrics.auc_ap_brier(bind.scored(s, d), "ChurnProbability", "Churn"),
    f"{S}, g AS (SELECT ChurnProbability AS s, sum(Churn)::DOUBLE AS p, count(*)::DOUBLE AS n FROM scored GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM g)",
    "SELECT round((sum(p * (below + (n + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))), 6) AS auc, round(sum(p * tp / seen) / sum(p), 6) AS ap, (SELECT round(avg((ChurnProbability - Churn) * (ChurnProbability - Churn)), 6) FROM scored) AS brier FROM w",
)
_cols = scoring.CENTROID_COLUMNS
_sq = " + ".join(f"(scored.{c} - m.{c}) * (scored.{c} - m.{c})" for c in _cols)
_sq2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _cols)
_add(
    "davies_bouldin",
    lambda s, d: metrics.davies_bouldin(bind.scored(s, d), "Segment", _cols),
    f"{S}, m AS (SELECT Segment, {', '.join(f'avg({c}) AS {c}' for c in _cols)} FROM scored GROUP BY 1), sp AS (SELECT Segment, avg(sqrt({_sq})) AS spread FROM scored JOIN m USING (Segment) GROUP BY 1), ms AS (SELECT * FROM m JOIN sp USING (Segment))",
    f"SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.Segment, max((a.spread + b.spread) / sqrt({_sq2})) AS r FROM ms a JOIN ms b ON a.Segment <> b.Segment GROUP BY 1)",
)
_add("class_weights", lambda s, d: metrics.class_weights(bind.scored(s, d), "Segment", "Churn"), S, "SELECT Segment, sum(Churn)::BIGINT AS positives, (count(*) - sum(Churn))::BIGINT AS negatives, round(CASE WHEN sum(Churn) = 0 THEN 5.0 ELSE greatest(1, (count(*) - sum(Churn)) / sum(Churn)::DOUBLE) END, 6) AS weight FROM scored GROUP BY 1")
_add(
    "stratified_split",
    lambda s, d: metrics.stratified_split(bind.scored(s, d), ["Segment", "Churn"], F.col("customer_id")).select("CustomerID", "is_train"),
    S,
    "SELECT CustomerID, row_number() OVER (PARTITION BY Segment, Churn ORDER BY customer_id) <= round(count(*) OVER (PARTITION BY Segment, Churn) * 0.8::DOUBLE) AS is_train FROM scored",
)
_add(
    "stratified_folds",
    lambda s, d: metrics.stratified_folds(bind.scored(s, d), ["Segment", "Churn"], F.col("customer_id")).select("CustomerID", "fold"),
    S,
    "SELECT CustomerID, ((row_number() OVER (PARTITION BY Segment, Churn ORDER BY customer_id) - 1) % 3)::INT AS fold FROM scored",
)
_add("kmeans_segments", _on(bind.customer_features, learn.kmeans_segments))
_add("gmm_soft", _on(bind.customer_features, learn.gmm_soft))
_add("pca_embedding", _on(bind.customer_features, learn.pca_embedding))
_add("neighbour_embedding", _on(bind.customer_features, learn.neighbour_embedding))
_add("k_sweep", _on(bind.customer_features, learn.k_sweep))
_add("bootstrap_stability", _on(bind.customer_features, learn.bootstrap_stability))
_add("uplift_t_s", _on(bind.scored, learn.uplift_scores))
_coded_rows = lambda s, d: staged(s, d, "coded", lambda: features.encode(bind.scored(s, d), features.CATEGORIES))
_churn_models = lambda s, d: staged(s, d, "churn_models", lambda: learn.churn_models(_coded_rows(s, d)))
_add("gbt_segment_scores", lambda s, d: learn.segment_scores(_coded_rows(s, d), models=_churn_models(s, d)))
_add("model_metrics", _on(_churn_models, learn.run_metrics))
_add("importance_top15", _on(_churn_models, learn.top_importances, "Champions"))
_add("model_drivers", lambda s, d: learn.model_drivers(_coded_rows(s, d), _churn_models(s, d)).select("CustomerID", "Segment", F.to_json("TopDrivers").alias("TopDrivers")))
_add("ari_histogram", lambda s, d: dashboard.binned(learn.bootstrap_agreement(bind.customer_features(s, d)), "ari", 25, -1.0, 1.0))

# ---------------------------------------------------------------- more dashboards, requests, plans

_labels = ", ".join(f"('{x}')" for x in SEGMENTS)
_add(
    "segment_kpis",
    _on(bind.customers, dashboard.segment_kpis, SEGMENTS),
    C,
    f"SELECT segment, coalesce(n, 0)::BIGINT AS customers, round(coalesce(r, 0), 6)::DOUBLE AS churn_rate FROM (VALUES {_labels}) v(segment) LEFT JOIN (SELECT segment, count(*) AS n, avg(churn) AS r FROM customers GROUP BY 1) USING (segment)",
)
_share = ", ".join(f"floor({x} * 100 / greatest(n, 1)::DOUBLE + 0.5)::BIGINT AS {k}_pct" for k, x in (("high", "h"), ("medium", "m"), ("boundary", "(n - h - m)")))
_add(
    "confidence_tiers_pct",
    _on(bind.customers, dashboard.confidence_share),
    C,
    f"SELECT segment, {_share}, round((h + m) / n::DOUBLE, 6) AS sure_share FROM (SELECT segment, count(*) AS n, sum(({_top} >= 0.9)::INT) AS h, sum(({_top} >= 0.8 AND {_top} < 0.9)::INT) AS m FROM customers GROUP BY 1)",
)
_add(
    "churn_histogram40",
    _on(bind.customers, dashboard.binned, "churn_probability", 40, 0.0, 1.0, "segment", ["At-Risk", "Lapsed", "Champions"]),
    C,
    "SELECT segment, least(floor(churn_probability * 40)::INT, 39) AS bin, count(*)::BIGINT AS count FROM customers WHERE segment IN ('At-Risk', 'Lapsed', 'Champions') AND churn_probability BETWEEN 0 AND 1 GROUP BY 1, 2",
)
_add(
    "uplift_scatter",
    _on(bind.customers, dashboard.scatter, ["segment", "customer_type", "uplift_score", "churn_probability"]),
    C,
    "SELECT customer_id, segment, customer_type, uplift_score, churn_probability, CASE risk_tier WHEN 'High Risk' THEN 1.0 WHEN 'Medium Risk' THEN 0.5 ELSE 0.0 END::DOUBLE AS risk FROM customers ORDER BY customer_id LIMIT 5000",
)
_add(
    "symmetric_ranges",
    _on(bind.customers, dashboard.symmetric_range, ["uplift_score", "net_roi"]),
    C,
    "SELECT 'uplift_score' AS axis, max(abs(uplift_score)) AS bound FROM customers UNION ALL SELECT 'net_roi', max(abs(net_roi)) FROM customers",
)
_add("sample_customers", lambda s, d: bind.customers(s, d).orderBy("customer_id").limit(10_000).select("customer_id", "segment", "risk_tier"), C, "SELECT customer_id, segment, risk_tier FROM customers ORDER BY customer_id LIMIT 10000")
_add(
    "batch_candidates",
    lambda s, d: serving.candidates(bind.customers(s, d)).select("customer_id", "segment", "net_roi", "intervention_priority"),
    C,
    f"SELECT customer_id, segment, net_roi, intervention_priority {_P} ORDER BY intervention_priority NULLS LAST, customer_id LIMIT 50",
)
_add(
    "campaign_summary",
    _log(dashboard.campaign_summary),
    oracle.AUDIT,
    "SELECT n AS total, r AS retained, c AS churned, n - r - c AS pending, floor(r * 100 / nullif(n, 0)::DOUBLE + 0.5)::BIGINT AS retained_pct, floor(c * 100 / nullif(n, 0)::DOUBLE + 0.5)::BIGINT AS churned_pct, floor(r * 100 / nullif(r + c, 0)::DOUBLE + 0.5)::BIGINT AS overall_rate "
    "FROM (SELECT count(*)::BIGINT AS n, coalesce(sum((outcome = 'retained')::INT), 0)::BIGINT AS r, coalesce(sum((outcome = 'churned')::INT), 0)::BIGINT AS c FROM acts LEFT JOIN latest ON retention_action_id = acts.id)",
)
_add("total_customers", lambda s, d: dashboard.total_customers(dashboard.segment_summary(bind.customers(s, d))), C, "SELECT count(*)::BIGINT AS total FROM customers")
_add(
    "tool_revenue_at_risk_segment",
    _on(bind.customers, agent.segment_revenue_at_risk, "Lapsed"),
    C,
    "SELECT segment, n::BIGINT AS total, floor(n * p + 0.5)::BIGINT AS expected_churners, floor(n * p + 0.5) * 500.0::DOUBLE AS revenue_at_risk FROM (SELECT segment, count(*) AS n, round(avg(churn_probability), 9) AS p FROM customers WHERE segment = 'Lapsed' GROUP BY 1)",
)
_add(
    "tool_success_rates_top",
    _log(agent.ranked_success_rates),
    oracle.AUDIT,
    f"SELECT * FROM ({_lastwins.format('intervention_type')}) ORDER BY total DESC, intervention_type LIMIT 5",
)
_add("tool_unknown", lambda s, d: agent.unknown_tools(load(s, d, "events").select(F.col("event_type").alias("tool")).distinct()), None, "SELECT DISTINCT event_type AS tool, 'unknown tool: ' || event_type AS error FROM events")
_add("tool_unknown_segment", _on(bind.customers, agent.segment_error, "Nobody"), C, "SELECT 'Segment ''Nobody'' not found.' AS error, string_agg(segment, '|' ORDER BY segment) AS valid_segments FROM (SELECT DISTINCT segment FROM customers)")
_saved = ["id", "customer_id", "segment", "churn_probability", "uplift_score", "net_roi", "intervention_type", "agent_reasoning", "agentic_mode"]


def _saved_actions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.array(F.struct(F.lit(1).alias("round"), F.lit("lookup").alias("tool"), F.col("customer_id").alias("args")))
    traced = bind.actions(spark, sf_dir).withColumn("trace", F.when(F.col("agentic_mode"), step))
    return serving.action_rows(traced, bind.customers(spark, sf_dir))


_saved_sql = (
    "SELECT acts.id::VARCHAR AS id, acts.customer_id, c.segment, churn_probability, uplift_score, net_roi, intervention_type, NULL::VARCHAR AS channel, NULL::VARCHAR AS timing, NULL::VARCHAR AS message_framing, "
    "CASE WHEN agentic_mode THEN '[{\"round\":1,\"tool\":\"lookup\",\"args\":\"' || acts.customer_id || '\"}]' END AS agent_reasoning, agentic_mode, generated_at, NULL::VARCHAR AS confidence "
    "FROM acts LEFT JOIN customers c ON acts.customer_id = c.customer_id WHERE intervention_type IS NOT NULL"
)


def _saved_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved_actions_whole(spark, sf_dir).select(*_saved)


_add(
    "audit_saved_actions",
    _saved_actions,
    oracle.AUDIT,
    "SELECT acts.id::VARCHAR AS id, acts.customer_id, c.segment, churn_probability, uplift_score, net_roi, intervention_type, CASE WHEN agentic_mode THEN '[{\"round\":1,\"tool\":\"lookup\",\"args\":\"' || acts.customer_id || '\"}]' END AS agent_reasoning, agentic_mode "
    "FROM acts LEFT JOIN customers c ON acts.customer_id = c.customer_id WHERE intervention_type IS NOT NULL",
)


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration table made of the data: the mean order value and the kinds of events; two keys are missing."""
    clv = load(spark, sf_dir, "orders").agg(F.lit("assumed_clv_usd").alias("key"), F.round(F.avg("o_totalprice"), 0).cast("long").cast("string").alias("value"))
    kinds = load(spark, sf_dir, "events").groupBy("event_type").count().groupBy().agg(F.lit("channels").alias("key"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("value"))
    got = serving.config(clv.unionByName(kinds))
    return got.select("assumed_clv", *[F.array_join(c, "|").alias(c) for c in ("intervention_types", "channels", "timing_options")])


_add(
    "config_values",
    _config,
    None,
    "SELECT (SELECT round(avg(o_totalprice), 0) FROM orders)::DOUBLE AS assumed_clv, (SELECT string_agg(event_type, '|' ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM events)) AS channels, "
    + ", ".join(f"'{serving.CONFIG[c].replace(',', '|')}' AS {c}" for c in ("intervention_types", "timing_options")),
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests: every tenth has an impossible satisfaction, every thirteenth no tenure."""
    f = bind.customer_features(spark, sf_dir)
    n = F.col("CustomerID").cast("long")
    rows = f.select("CustomerID", *features.CHURN_NUMERIC).withColumn("SatisfactionScore", F.when(n % 10 == 0, 10).otherwise(F.col("SatisfactionScore"))).withColumn("Tenure", F.when(n % 13 != 0, F.col("Tenure")))
    return serving.score_requests(rows, features.feature_stats(f)).drop("errors")


_add(
    "score_requests",
    _requests,
    S,
    "SELECT CustomerID, ok AS valid, CASE WHEN ok THEN Segment END AS segment, CASE WHEN ok THEN round(ChurnProbability + 3.1e-7, 4) END AS churn_probability, CASE WHEN ok THEN (ChurnProbability >= 0.5)::INT END AS churn_prediction, "
    "CASE WHEN NOT ok THEN NULL WHEN ChurnProbability < 0.3 THEN 'Low Risk' WHEN ChurnProbability < 0.6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_tier, CASE WHEN NOT ok THEN NULL WHEN ChurnProbability >= 0.3 THEN 'Lost Cause' ELSE 'Sleeping Dog' END AS customer_type "
    "FROM (SELECT *, (customer_id % 10 <> 0 AND customer_id % 13 <> 0) AS ok FROM scored)",
)
#: What surrounds a message in a reply, by conversation: before its text, between text and turn, after the turn.
_wraps = [
    ("<think>", "</think> ```json\n{\"a\": ", "}\n``` bye"), ("```\n{\"b\": 3.5, \"a\": ", "", "}\n``` and "), ("  ", " ", "  "), ("<THINK>x</think><function=f>", "</function>no json ", ""), ("", "```json {\"a\": oops} ", "```"), ("```json\n{\"a\": 4}\n```", "<think>", "</think>"),
]


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as replies of a provider, in six kinds of wrapping; of the second kind only the turn is kept, so it is JSON."""
    k = (F.col("conv_id") % len(_wraps) + 1).cast("int")
    part = lambda i: F.element_at(F.lit([w[i] for w in _wraps]), k)
    reply = F.concat(part(0), F.when(k != 2, F.col("text")).otherwise(""), part(1), F.col("turn").cast("string"), part(2))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", serving.stripped(reply).alias("reply"))
    rows = rows.withColumn("json", serving.fenced_json(F.col("reply")))
    return rows.withColumn("a", F.element_at(serving.numbers_of(F.col("json")), "a"))


_part = lambda i: "[" + ", ".join("'" + w[i].replace("'", "''") + "'" for w in _wraps) + f"][conv_id % {len(_wraps)} + 1]"
_add(
    "clean_replies",
    _clean,
    f"r AS (SELECT conv_id, turn, {_part(0)} || CASE WHEN conv_id % {len(_wraps)} <> 1 THEN text ELSE '' END || {_part(1)} || turn || {_part(2)} AS x FROM conversations), "
    "t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(x, '(?is)<think>.*?</think>', '', 'g'), '(?is)<function=.*?</function>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS reply FROM r), "
    "j AS (SELECT *, regexp_replace(CASE WHEN contains(reply, '```json') THEN split_part(split_part(reply, '```json', 2), '```', 1) WHEN contains(reply, '```') THEN split_part(split_part(reply, '```', 2), '```', 1) ELSE reply END, '^\\s+|\\s+$', '', 'g') AS json FROM t)",
    "SELECT conv_id, turn, reply, json, CASE WHEN json_valid(json) THEN TRY_CAST(json_extract_string(json, '$.a') AS DOUBLE) END AS a FROM j",
)
_both = oracle.DRIVERS + ",\n" + oracle.CUSTOMERS[len(oracle.SCORED) :].lstrip(",\n ")
_add(
    "retention_prompts",
    lambda s, d: serving.prompts(bind.customers(s, d), bind.with_drivers(s, d)),
    f"{_both}, why AS (SELECT CustomerID AS customer_id, string_agg(printf('%s %.4f', feature, value), '; ' ORDER BY rank) AS why FROM drivers GROUP BY 1)",
    "SELECT customer_id, printf('Customer %s. Segment: %s. Type: %s. Tier: %s. Churn probability %.1f%%. Uplift %.4f. Net ROI $%.2f. Tenure %.0f. Satisfaction %d of 5. Days since last order %.0f. Hours on app %.1f. Complained: %d. Orders %d. Cashback $%.2f.', customer_id, segment, customer_type, risk_tier, "
    "round(churn_probability * 100 + 3.1e-4, 1), round(uplift_score + 3.1e-7, 4), round(net_roi + 3.1e-5, 2), tenure, satisfaction_score, days_since_last_order, hour_spend_on_app, complain, order_count, round(cashback_amount + 3.1e-5, 2)) || ' Drivers: ' || coalesce(why, 'none') || '.' AS prompt "
    "FROM customers LEFT JOIN why USING (customer_id)",
)
_seed_rows = ", ".join(f"('{k}', '{m}', '{c}')" for _, k, _, m, c in playbook.SEEDS)
_plan_risk = "CASE WHEN value > 0 THEN 'high ' ELSE 'low ' END || feature"
_add(
    "batch_plans",
    lambda s, d: serving.displayed(serving.batch_plans(bind.customers(s, d), bind.with_drivers(s, d))).select("customer_id", "segment", "intervention_priority", "risk", *serving.PLAN_KEYS, "error", "raw_response", "display"),
    f"{_both}, best AS (SELECT customer_id, segment, intervention_priority {_P} ORDER BY intervention_priority NULLS LAST, customer_id LIMIT 50), asked AS (SELECT best.*, {_plan_risk} AS risk FROM best JOIN drivers ON CustomerID = customer_id AND rank = 1), "
    f"found AS (SELECT *, {_case} AS keyword FROM asked), typed2 AS (SELECT *, {_kv} AS intervention_type FROM found)",
    "SELECT customer_id, segment, intervention_priority, risk, keyword AS primary_risk_reason, NULL::VARCHAR AS customer_receptivity, intervention_type, 'Email' AS channel, 'Within 24 hours' AS timing, m AS message_framing, "
    "c AS intervention_cost_estimate, NULL::VARCHAR AS expected_outcome, 'Medium' AS confidence, NULL::VARCHAR AS do_not_intervene_reason, NULL::VARCHAR AS error, NULL::VARCHAR AS raw_response, "
    "concat_ws(chr(10), '**Intervention:** ' || intervention_type, '**Channel:** Email | **Timing:** Within 24 hours', '**Cost:** ' || c || ' | **Confidence:** Medium', '', '**Why they''re at risk:** ' || keyword, '**Will they respond?** N/A', '', "
    f"'**Suggested Message:**', '> ' || m, '', '**Expected Outcome:** N/A') AS display FROM typed2 JOIN (VALUES {_seed_rows}) s(k, m, c) ON k = keyword",
)

# ---------------------------------------------------------------- the adapters' steps


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as payments; open ones have no type."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("payment_value"), F.col("l_linenumber").alias("payment_installments"), F.when(F.col("l_linestatus") != "O", F.col("l_returnflag")).alias("payment_type")
    )


_add(
    "order_payments",
    lambda s, d: features.order_payments(_payments(s, d)).select("order_id", "payment_type", steady(F.col("payment_value"), 4).alias("payment_value"), steady(F.col("avg_installments"), 6).alias("avg_installments")),
    f"p AS (SELECT l_orderkey AS order_id, l_extendedprice AS v, l_linenumber AS i, CASE WHEN l_linestatus <> 'O' THEN l_returnflag END AS kind FROM lineitem), m AS ({oracle._mode('order_id', 'kind', 'p', '')})",
    "SELECT order_id, coalesce(m.v, 'credit_card') AS payment_type, round(sum(p.v) + 3.1e-7, 4) AS payment_value, round(avg(i) + 3.1e-9, 6) AS avg_installments FROM p LEFT JOIN m USING (order_id) GROUP BY order_id, m.v",
)


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews of their user; every ninth was never answered."""
    n = F.col("event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), n.alias("review_id"), F.when(n % 9 != 0, F.col("ts")).alias("answered_at"), (n % 5 + 1).alias("review_score"))


_add(
    "latest_reviews",
    _on(_reviews, features.latest_reviews),
    None,
    "SELECT order_id, review_score FROM (SELECT user_id AS order_id, event_id % 5 + 1 AS review_score, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 9 = 0) DESC, CASE WHEN event_id % 9 <> 0 THEN ts END DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
_add(
    "impute_all",
    lambda s, d: features.impute_all(load(s, d, "part").select("p_partkey", *[F.when(F.col("p_partkey") % k != 0, F.col(c)).cast("double").alias(c) for c, k in (("p_size", 9), ("p_retailprice", 7))]), ("p_partkey",)),
    "g AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size END::DOUBLE AS s, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS r FROM part)",
    "SELECT p_partkey, coalesce(s, (SELECT median(s) FROM g)) AS p_size, coalesce(r, (SELECT median(r) FROM g)) AS p_retailprice FROM g",
)
_coded = ["PreferredPaymentMode", "PreferedOrderCat"]
_add(
    "coded_categories",
    lambda s, d: features.coded_categories(bind.customer_features(s, d)).select("CustomerID", *_coded, "Gender", "MaritalStatus", "PreferredLoginDevice"),
    oracle.FEATURES,
    f"SELECT CustomerID, {', '.join(f'(dense_rank() OVER (ORDER BY {c}) - 1)::INT AS {c}' for c in _coded)}, 0 AS Gender, 0 AS MaritalStatus, 0 AS PreferredLoginDevice FROM features",
)
_add(
    "uplift_summary",
    _on(bind.scored, metrics.uplift_summary),
    S,
    "SELECT sum(Treatment)::BIGINT AS treatment_group_size, sum(1 - Treatment)::BIGINT AS control_group_size, round(avg(CASE WHEN Treatment = 1 THEN Churn END), 6) AS treatment_churn_rate, round(avg(CASE WHEN Treatment = 0 THEN Churn END), 6) AS control_churn_rate, "
    "round(avg(UpliftScore), 6) AS mean_uplift, round(stddev_pop(UpliftScore), 6) AS std_uplift FROM scored",
)
_profiled = ["Tenure", "OrderCount", "SatisfactionScore"]
_add(
    "profiled_candidates",
    lambda s, d: serving.with_profile(serving.candidates(bind.customers(s, d)), scoring.segment_profiles(bind.scored(s, d))).select("customer_id", "segment", *[f"profile_{c}" for c in [*_profiled, "Count", "ChurnRate"]]),
    C,
    f"SELECT customer_id, segment, {', '.join(f'profile_{c}' for c in _profiled)}, profile_Count, profile_ChurnRate FROM (SELECT customer_id, segment {_P} ORDER BY intervention_priority NULLS LAST, customer_id LIMIT 50) "
    f"LEFT JOIN (SELECT Segment AS segment, {', '.join(f'round(avg({c}), 3) AS profile_{c}' for c in _profiled)}, count(*) AS profile_Count, round(avg(Churn), 3) AS profile_ChurnRate FROM scored GROUP BY 1) USING (segment)",
)

# ---------------------------------------------------------------- the ten SQL functions, and the logs


def _function(call: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql_functions.register(bind.customers(spark, sf_dir), bind.with_drivers(spark, sf_dir))
        return spark.sql(f"SELECT * FROM {call}")

    return run


for _call, _same in {
    "get_segment_summary()": "rpc_segment_summary", "get_churn_kpis('Lapsed')": "rpc_churn_kpis_segment", "get_churn_histogram()": "rpc_churn_histogram", "get_risk_summary()": "rpc_risk_summary", "get_shap_summary('At-Risk')": "rpc_shap_summary_segment",
    "get_avg_churn_by_segment()": "rpc_avg_churn_by_segment", "get_customer_type_summary()": "rpc_customer_type_summary", "get_roi_by_segment()": "rpc_roi_by_segment", "get_top_persuadables(p_limit => 200)": "rpc_top_persuadables", "get_uplift_kpis()": "rpc_uplift_kpis",
}.items():
    QUERIES["sql_" + _call.split("(")[0]], ORACLES["sql_" + _call.split("(")[0]] = _function(_call), ORACLES[_same]


def _logged(rows: Callable[[SparkSession, str], DataFrame], schema) -> Query:
    """Rows appended to a new log in two batches, each of them twice, and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = f"{shared_dir(spark)}/tidemark-log-{uuid.uuid4().hex}", rows(spark, sf_dir)
        for _ in range(2):
            for k in range(2):
                logs.append_once(df.filter(F.crc32(F.encode("id", "UTF-8")) % 2 == k), path, k, schema)
        return logs.read_log(spark, path, schema).drop("batch")

    return run


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_add("MINUTE", (F.col("conv_id") * 10 + F.col("turn")).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    tools = F.when(F.col("role") == "assistant", F.array(F.col("turn").cast("string")))
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), (F.col("conv_id") % 7).cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"), at.alias("created_at"), tools.alias("tools"))


_add(
    "log_feedback",
    _logged(lambda s, d: serving.feedback_rows(bind.feedback(s, d), bind.actions(s, d)), serving.FEEDBACK),
    oracle.AUDIT,
    "SELECT fb.id::VARCHAR AS id, retention_action_id::VARCHAR AS retention_action_id, acts.customer_id, outcome, logged_at FROM fb LEFT JOIN acts ON acts.id = retention_action_id",
)
_add("log_actions", _logged(_saved_actions_whole, serving.ACTIONS), oracle.AUDIT, _saved_sql)
_add(
    "log_conversations",
    _logged(lambda s, d: serving.conversation_rows(_messages(s, d)), serving.CONVERSATIONS),
    None,
    "SELECT conv_id::VARCHAR AS id, (conv_id % 7)::VARCHAR AS session_id, TIMESTAMP '2024-01-01' + to_minutes(min(conv_id * 10 + turn)::BIGINT) AS created_at FROM conversations GROUP BY conv_id",
)
_add(
    "log_messages",
    _logged(lambda s, d: serving.message_rows(_messages(s, d)), serving.MESSAGES),
    None,
    "SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS conversation_id, role, text AS content, CASE WHEN role = 'assistant' THEN '[\"' || turn || '\"]' END AS tool_calls, TIMESTAMP '2024-01-01' + to_minutes((conv_id * 10 + turn)::BIGINT) AS created_at FROM conversations",
)
_add(
    "playbook_seeded",
    lambda s, d: audit.insert_missing(_benchmark_book(s, d), playbook.seeds(s).select("position", "risk_factor_keyword", "intervention"), "risk_factor_keyword").unionByName(_benchmark_book(s, d).withColumn("position", F.col("position").cast("int"))),
    None,
    f"WITH book AS (SELECT item_id::INT AS position, lower(split_part(text, ' ', 3)) AS risk_factor_keyword, [{', '.join(repr(t) for t in bind.TYPES)}][item_id % 7 + 1] AS intervention FROM benchmark) SELECT * FROM book UNION ALL "
    f"SELECT p, k, v FROM (VALUES {', '.join(f'({p}, {k!r}, {v!r})' for p, k, v, _, _ in playbook.SEEDS)}) s(p, k, v) WHERE k NOT IN (SELECT risk_factor_keyword FROM book)",
)

# ---------------------------------------------------------------- the telecom adapter, checks, upserts and CSV over given tables


def _telecom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a raw telecom table: padded names, columns known only after the fact, flags and groups as text, and gaps."""
    k = F.col("c_custkey")
    gap = lambda n, c: F.when(k % n != 0, c)
    raw = load(spark, sf_dir, "customer").select(
        k.cast("string").alias("CustomerID"), F.element_at(F.lit([" Yes", "no", "1"]), (k % 3 + 1).cast("int")).alias(" Churn "), gap(11, k % 61).cast("string").alias("MonthsInService"), gap(7, F.col("c_acctbal")).alias("MonthlyRevenue"),
        gap(13, k * 7 % 1500).alias("MonthlyMinutes"), (k % 8).alias("Handsets"), F.element_at(F.lit([*features.RATINGS, "?"]), (k % 8 + 1).cast("int")).alias("CreditRating"), gap(5, k % 9).alias("CustomerCareCalls"), (k % 40 - 20).alias("PercChangeRevenues"),
        gap(17, k * 3 % 900).alias("CurrentEquipmentDays"), F.when(k % 2 == 0, " yes ").otherwise("No").alias("RespondsToMailOffers"), gap(19, k % 70).alias("RoamingCalls"), (k % 7).alias("UniqueSubs"), F.concat(F.lit("grp "), (k % 6).cast("string")).alias("IncomeGroup"),
        F.when(k % 4 == 0, "Known Homeowner").when(k % 4 == 1, " known homeowner").otherwise("Unknown").alias("Homeownership"), gap(23, F.col("c_mktsegment")).alias("Occupation"), F.substring("c_mktsegment", 1, 1).alias("MaritalStatus"),
        F.when(k % 3 == 0, "TRUE").otherwise("0").alias("HandsetWebCapable"), F.lit(1).alias("RetentionCalls"),
    )
    return features.telecom(features.telecom_clean(raw))


_tele = ["CustomerID", "Churn", "Tenure", "AvgOrderValue", "OrderCount", "HourSpendOnApp", "NumberOfDeviceRegistered", "SatisfactionScore", "Complain", "OrderAmountHikeFromlastYear", "DaySinceLastOrder", "CashbackAmount", "CouponUsed", "WarehouseToHome", "NumberOfAddress", "CityTier", "PreferredPaymentMode", "PreferedOrderCat", "MaritalStatus", "PreferredLoginDevice"]
_filled = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM x)) AS {c}" for c in ("EngagementScore", "DiscountSensitivity", "TenureStability"))
_add(
    "telecom_features",
    lambda s, d: _telecom(s, d).select(*_tele, *features.COMPOSITES),
    "r AS (SELECT *, c_custkey AS k FROM customer), "
    "b AS (SELECT k::VARCHAR AS CustomerID, (k % 3 IN (0, 2))::INT AS Churn, CASE WHEN k % 11 <> 0 THEN greatest(k % 61, 1)::DOUBLE END AS t, greatest(0, coalesce(CASE WHEN k % 7 <> 0 THEN c_acctbal END, 50)) AS AvgOrderValue, "
    "  greatest(0, least(10, coalesce(CASE WHEN k % 13 <> 0 THEN k * 7 % 1500 END, 0) / 100::DOUBLE)) AS HourSpendOnApp, greatest(1, least(5, k % 8))::DOUBLE AS NumberOfDeviceRegistered, "
    f"  greatest(1, least(5, [{', '.join(str(v) for v in features.RATINGS.values())}, 2][k % 8 + 1]))::INT AS SatisfactionScore, (coalesce(CASE WHEN k % 5 <> 0 THEN k % 9 END, 0) > 3)::INT AS Complain, greatest(0, k % 40 - 20)::DOUBLE AS OrderAmountHikeFromlastYear, "
    "  greatest(0, coalesce(CASE WHEN k % 17 <> 0 THEN k * 3 % 900 END, 180))::DOUBLE AS DaySinceLastOrder, (k % 2 = 0)::INT AS CouponUsed, greatest(0, least(50, coalesce(CASE WHEN k % 19 <> 0 THEN k % 70 END, 0)))::DOUBLE AS WarehouseToHome, "
    "  greatest(1, least(5, k % 7))::DOUBLE AS NumberOfAddress, greatest(1, least(3, k % 6))::INT AS CityTier, (k % 4 = 0)::INT AS PreferredPaymentMode, coalesce(CASE WHEN k % 23 <> 0 THEN c_mktsegment END, 'nan') AS o, substr(c_mktsegment, 1, 1) AS m, (k % 3 = 0)::INT AS PreferredLoginDevice FROM r), "
    "c AS (SELECT *, AvgOrderValue * CouponUsed AS CashbackAmount, (dense_rank() OVER (ORDER BY o) - 1)::INT AS PreferedOrderCat, (dense_rank() OVER (ORDER BY m) - 1)::INT AS MaritalStatus FROM b), "
    "g AS (SELECT greatest(max(HourSpendOnApp), 1) AS mh, greatest(max(t), 1) AS mo, max(DaySinceLastOrder) AS md, greatest(max(NumberOfDeviceRegistered), 1) AS mdev, greatest(max(NumberOfAddress), 1) AS madr, max(NumberOfDeviceRegistered) AS rdev, max(NumberOfAddress) AS radr, max(OrderAmountHikeFromlastYear) AS mhike, max(WarehouseToHome) AS mw FROM c), "
    "x AS (SELECT c.*, round(0.5 * (HourSpendOnApp / mh) + 0.5 * (t / mo) + 3.1e-9, 6) AS EngagementScore, round(DaySinceLastOrder / CASE WHEN md > 0 THEN md ELSE 1 END + 3.1e-9, 6) AS RecencySignal, round((NumberOfDeviceRegistered + NumberOfAddress) / (rdev + radr) + 3.1e-9, 6) AS StickinessIndex, "
    "  round(OrderAmountHikeFromlastYear / (mhike + 1e-9) + 3.1e-9, 6) AS SpendTrend, round(0.6::DOUBLE * Complain + 0.4::DOUBLE * (SatisfactionScore - 1) / 4 + 3.1e-9, 6) AS SupportRiskScore, round(CouponUsed / (t + 1e-9) + 3.1e-9, 6) AS DiscountSensitivity, round(ln(1 + t) + 3.1e-9, 6) AS TenureStability, "
    "  round(WarehouseToHome / (mw + 1e-9) + 3.1e-9, 6) AS WarehouseFriction FROM c CROSS JOIN g)",
    "SELECT "
    + ", ".join(f"coalesce(t, (SELECT median(t) FROM x)) AS {c}" if c in ("Tenure", "OrderCount") else c for c in _tele)
    + f", {_filled}, RecencySignal, StickinessIndex, SpendTrend, SupportRiskScore, WarehouseFriction FROM x",
)
_add(
    "validation_report",
    lambda s, d: validate.report(load(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority")), ["o_orderkey", "o_orderpriority", "o_nothing"], 10**9),
    None,
    "SELECT 'present' AS \"check\", c AS \"column\", v::DOUBLE AS value, v = 1 AS ok FROM (VALUES ('o_orderkey', 1), ('o_orderpriority', 1), ('o_nothing', 0)) t(c, v) UNION ALL SELECT 'missing_rate', 'o_orderkey', 0, true "
    "UNION ALL SELECT 'missing_rate', 'o_orderpriority', round(avg((o_orderkey % 3 = 0)::INT), 6), avg((o_orderkey % 3 = 0)::INT) <= 0.3 FROM orders UNION ALL SELECT 'rows', NULL, count(*)::DOUBLE, count(*) >= 1000000000 FROM orders",
)


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a stage, then every third one with another balance, some of them twice, and some new ones."""
    path = f"{shared_dir(spark)}/tidemark-upsert-{uuid.uuid4().hex}"
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("updated_at"))
    upsert_stage(c, path, "id")
    again = c.filter("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(10**6)).alias("id"), (F.col("balance") * 2).alias("balance"), F.lit(2).alias("updated_at"))
    return upsert_stage(again.unionByName(again.filter("id % 4 = 0").withColumns({"balance": F.lit(-1.0), "updated_at": F.lit(1)})), path, "id")


_add(
    "upserted_customers",
    _upserted,
    None,
    "WITH c AS (SELECT c_custkey AS id, c_acctbal AS balance FROM customer) SELECT id, CASE WHEN id % 6 = 0 THEN balance * 2 ELSE balance END AS balance, CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END AS updated_at FROM c "
    "UNION ALL SELECT id + 1000000, balance * 2, 2 FROM c WHERE id % 6 = 3",
)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts exported as CSV with padded names, and read as the only table of a folder that has a holdout too."""
    path = f"{shared_dir(spark)}/tidemark-csv-{uuid.uuid4().hex}"
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias(" p_partkey "), F.col("p_type").alias("p_type "), F.col("p_retailprice").alias("p_retailprice"))
    audit.export_plans(parts, f"{path}/b.csv")
    audit.export_plans(parts.limit(0), f"{path}/a_holdout.csv")
    return read_table(spark, f"{path}/{pick_csv(['a_holdout.csv', 'b.csv'])}")


_add("csv_tables", _csv, None, "SELECT p_partkey::INT AS p_partkey, p_type, p_retailprice FROM part")
