"""The dashboard's ten functions as SQL table functions over the serving table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that ``get_top_persuadables`` can give at most, whatever its argument: SQL needs a constant to keep a sort from passing through one task.
MOST = 10_000

_TOP = "greatest(" + ", ".join(f"coalesce(gmm_prob_seg{i}, 0)" for i in range(5)) + ")"
_SHARE = "round(avg(CASE WHEN {} THEN 1.0D ELSE 0.0D END), 6)"
_SUM = "sum(CASE WHEN {} THEN 1 ELSE 0 END)"
_P = "customer_type = 'Persuadable'"
_OF = "(p_segment IS NULL OR segment = p_segment)"

#: (name, parameters, columns, body); the body reads the views ``served_customers`` and ``served_drivers``.
FUNCTIONS = [
    (
        "get_segment_summary",
        "",
        "segment STRING, customer_count BIGINT, churn_rate DOUBLE, avg_churn_prob DOUBLE, high_risk_pct DOUBLE, persuadable_pct DOUBLE, avg_tenure DOUBLE, avg_satisfaction DOUBLE, avg_days_since_order DOUBLE, avg_hour_spend DOUBLE, avg_cashback DOUBLE, gmm_high BIGINT, gmm_medium BIGINT, gmm_boundary BIGINT",
        f"SELECT segment, count(*), round(avg(churn), 6), round(avg(churn_probability), 6), {_SHARE.format("risk_tier = 'High Risk'")}, {_SHARE.format(_P)}, round(avg(tenure), 6), round(avg(satisfaction_score), 6), round(avg(days_since_last_order), 6), "
        f"round(avg(hour_spend_on_app), 6), round(avg(cashback_amount), 6), {_SUM.format(_TOP + ' >= 0.9')}, {_SUM.format(f'{_TOP} >= 0.8 AND {_TOP} < 0.9')}, {_SUM.format(_TOP + ' < 0.8')} FROM served_customers GROUP BY segment",
    ),
    (
        "get_churn_kpis",
        "p_segment STRING DEFAULT NULL",
        "total BIGINT, high_risk BIGINT, avg_churn_prob DOUBLE, actual_churners BIGINT",
        f"SELECT count(*), {_SUM.format("risk_tier = 'High Risk'")}, round(avg(churn_probability), 6), sum(churn) FROM served_customers WHERE {_OF}",
    ),
    ("get_churn_histogram", "p_segment STRING DEFAULT NULL", "bucket INT, count BIGINT", f"SELECT least(cast(floor(churn_probability * 10) AS INT), 9), count(*) FROM served_customers WHERE {_OF} GROUP BY 1"),
    (
        "get_risk_summary",
        "",
        "segment STRING, high_risk BIGINT, medium_risk BIGINT, low_risk BIGINT",
        "SELECT segment, " + ", ".join(_SUM.format(f"risk_tier = '{t} Risk'") for t in ("High", "Medium", "Low")) + " FROM served_customers GROUP BY segment",
    ),
    (
        "get_shap_summary",
        "p_segment STRING DEFAULT NULL",
        "feature STRING, avg_importance DOUBLE",
        f"SELECT feature, round(avg(abs(value)), 6) AS i FROM served_drivers WHERE {_OF} GROUP BY feature ORDER BY i DESC, feature LIMIT 8",
    ),
    ("get_avg_churn_by_segment", "", "segment STRING, avg_churn_prob DOUBLE", "SELECT segment, round(avg(churn_probability), 6) FROM served_customers GROUP BY segment"),
    (
        "get_customer_type_summary",
        "",
        "customer_type STRING, count BIGINT, avg_uplift_score DOUBLE, avg_net_roi DOUBLE, positive_roi_count BIGINT, avg_churn_prob DOUBLE",
        f"SELECT customer_type, count(*), round(avg(uplift_score), 6), round(avg(net_roi), 6), {_SUM.format('roi_positive')}, round(avg(churn_probability), 6) FROM served_customers GROUP BY customer_type",
    ),
    ("get_roi_by_segment", "", "segment STRING, avg_roi DOUBLE, persuadable_count BIGINT", f"SELECT segment, round(avg(net_roi), 6), count(*) FROM served_customers WHERE {_P} GROUP BY segment"),
    (
        "get_top_persuadables",
        "p_limit INT DEFAULT 200",
        "customer_id STRING, segment STRING, churn_probability DOUBLE, uplift_score DOUBLE, net_roi DOUBLE, intervention_priority DOUBLE",
        "SELECT customer_id, segment, churn_probability, uplift_score, net_roi, intervention_priority FROM (SELECT *, row_number() OVER (ORDER BY net_roi DESC NULLS FIRST, customer_id) AS k FROM "
        f"(SELECT * FROM served_customers WHERE {_P} ORDER BY net_roi DESC NULLS FIRST, customer_id LIMIT {MOST})) WHERE k <= p_limit",
    ),
    (
        "get_uplift_kpis",
        "",
        "persuadable_count BIGINT, positive_roi_count BIGINT, avg_uplift_score DOUBLE, total_roi_potential DOUBLE",
        f"SELECT {_SUM.format(_P)}, {_SUM.format('roi_positive')}, round(avg(uplift_score), 6), round(sum(CASE WHEN {_P} AND roi_positive THEN net_roi ELSE 0.0D END), 6) FROM served_customers",
    ),
]


def register(customers: DataFrame, drivers: DataFrame | None = None) -> list[str]:
    """Make the ten functions known to the session, over the serving table and the drivers (Segment, TopDrivers); returns their names.

    They are temporary: ``SELECT * FROM get_churn_kpis('Lapsed')``, ``SELECT * FROM get_top_persuadables(p_limit => 5)``. A table function gives no order; sort the result where it matters. Without drivers,
    ``get_shap_summary`` finds none. Registering again takes the new tables.
    """
    spark: SparkSession = customers.sparkSession
    customers.createOrReplaceTempView("served_customers")
    if drivers is None:
        spark.createDataFrame([], "segment string, feature string, value double").createOrReplaceTempView("served_drivers")
    else:
        drivers.select(F.col("Segment").alias("segment"), F.explode("TopDrivers").alias("feature", "value")).createOrReplaceTempView("served_drivers")
    for name, parameters, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return [f[0] for f in FUNCTIONS]
