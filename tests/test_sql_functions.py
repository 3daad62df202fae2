"""The ten SQL functions against the DataFrame queries."""

from collections import Counter

import pytest

from tidemark.operators import dashboard
from tidemark.plans import bind, sql_functions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    customers, drivers = bind.customers(spark, SF), bind.with_drivers(spark, SF)
    assert sql_functions.register(customers, drivers) == [f[0] for f in sql_functions.FUNCTIONS] and len(sql_functions.FUNCTIONS) == 10
    return customers, drivers


CASES = {
    "get_segment_summary()": lambda c, d: dashboard.segment_summary(c),
    "get_churn_kpis()": lambda c, d: dashboard.churn_kpis(c),
    "get_churn_kpis('Lapsed')": lambda c, d: dashboard.churn_kpis(c, "Lapsed"),
    "get_churn_kpis(p_segment => 'Nobody')": lambda c, d: dashboard.churn_kpis(c, "Nobody"),
    "get_churn_histogram()": lambda c, d: dashboard.histogram(c),
    "get_churn_histogram('At-Risk')": lambda c, d: dashboard.histogram(c, "At-Risk"),
    "get_risk_summary()": lambda c, d: dashboard.risk_summary(c),
    "get_shap_summary()": lambda c, d: dashboard.driver_summary(d),
    "get_shap_summary('At-Risk')": lambda c, d: dashboard.driver_summary(d, "At-Risk"),
    "get_avg_churn_by_segment()": lambda c, d: dashboard.avg_churn(c),
    "get_customer_type_summary()": lambda c, d: dashboard.type_summary(c),
    "get_roi_by_segment()": lambda c, d: dashboard.roi_by_segment(c),
    "get_top_persuadables()": lambda c, d: dashboard.top_persuadables(c),
    "get_top_persuadables(7)": lambda c, d: dashboard.top_persuadables(c, 7),
    "get_uplift_kpis()": lambda c, d: dashboard.uplift_kpis(c),
}


@pytest.mark.parametrize("call", CASES)
def test_functions_equal_the_queries(spark, tables, call):
    got, want = spark.sql(f"SELECT * FROM {call}"), CASES[call](*tables)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_functions_follow_the_tables_they_are_registered_on(spark, tables):
    try:
        sql_functions.register(tables[0].filter("segment = 'Lapsed'"))
        assert spark.sql("SELECT total FROM get_churn_kpis()").first()[0] == tables[0].filter("segment = 'Lapsed'").count()
        assert spark.sql("SELECT * FROM get_shap_summary()").count() == 0
    finally:
        sql_functions.register(*tables)
