"""The assistant's tools: each a function of tables and arguments to a DataFrame; nothing found is no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.semantics import CLV, COST, is_true, js_round, shown, steady
from tidemark.operators import audit

# The playbook table's keywords in match order, with their interventions; and the keys of the JSON playbook with theirs.
KEYWORDS = [
    ("satisfaction", "Proactive Support Call"),
    ("complain", "Service Recovery"),
    ("days_since_last_order", "Reactivation Campaign"),
    ("tenure", "Loyalty Reward"),
    ("order_count", "Personalized Content"),
    ("cashback", "Discount Offer"),
    ("default", "Personalized Content"),
]
PLAYBOOK = [
    ("high_supportriskscore", "Proactive Support Call"),
    ("high_recencysignal", "Reactivation Campaign"),
    ("low_engagementscore", "Personalized Content"),
    ("low_satisfactionscore", "Service Recovery"),
    ("high_satisfactionscore", "Service Recovery"),
    ("high_complain", "Service Recovery"),
    ("low_tenure", "Loyalty Reward"),
    ("low_stickiness", "Personalized Content"),
    ("high_discountsensitivity", "Discount Offer"),
    ("low_cashback", "Loyalty Reward"),
    ("low_ordercount", "Discount Offer"),
    ("high_spendtrend", "Premium Upgrade"),
    ("default", "Loyalty Reward"),
]


def lookup(customers: DataFrame, customer_id: str) -> DataFrame:
    """One customer's profile; ``coupons_used`` too, where the table has ``coupon_used``."""
    coupons = [F.col("coupon_used").cast("long").alias("coupons_used")] if "coupon_used" in customers.columns else []
    c = customers.filter(F.col("customer_id") == str(customer_id))
    return c.select(
        "customer_id", "segment", "risk_tier", "customer_type", F.bround("churn_probability", 3).alias("churn_probability"), F.bround("uplift_score", 3).alias("uplift_score"),
        F.bround("net_roi", 2).alias("net_roi"), F.col("tenure").cast("long").alias("tenure"), F.col("satisfaction_score").cast("long").alias("satisfaction_score"), (F.col("complain") > 0).alias("complained"),
        F.bround("hour_spend_on_app", 1).alias("hours_on_app"), F.col("days_since_last_order").cast("long").alias("days_since_last_order"), F.col("order_count").cast("long").alias("orders"), F.bround("cashback_amount", 2).alias("cashback"), (F.col("churn") > 0).alias("churned"), *coupons,
    )


def segment_benchmark(customers: DataFrame, segment: str) -> DataFrame:
    """Averages that skip nulls; no rows for an unknown segment."""
    return customers.filter(F.col("segment") == segment).groupBy("segment").agg(
        F.count("*").alias("customers"), F.round(F.avg("churn"), 3).alias("churn_rate"), F.round(F.avg("churn_probability"), 3).alias("avg_churn_probability"), F.round(F.avg("uplift_score"), 3).alias("avg_uplift"),
        F.round(F.avg((F.col("risk_tier") == "High Risk").cast("int")), 3).alias("pct_high_risk"), F.round(F.avg((F.col("customer_type") == "Persuadable").cast("int")), 3).alias("pct_persuadable"), F.round(F.avg("tenure"), 1).alias("avg_tenure"),
        F.round(F.avg("satisfaction_score"), 2).alias("avg_satisfaction"), F.round(F.avg("days_since_last_order"), 1).alias("avg_days_since_last_order"), F.round(F.avg("hour_spend_on_app"), 1).alias("avg_hours_on_app"), F.round(F.avg("complain"), 3).alias("complaint_rate"),
    )


def segment_error(customers: DataFrame, segment: str) -> DataFrame:
    """(error, valid_segments): one row, with the segments that there are, if nobody is in ``segment``; else none."""
    every = customers.groupBy("segment").agg(F.lit(1).alias("one")).filter(F.col("segment").isNotNull())  # some segments
    known = every.agg(F.array_join(F.array_sort(F.collect_set("segment")), "|").alias("valid_segments"), F.count_if(F.col("segment") == segment).alias("there"))
    return known.filter("there = 0").select(F.lit(f"Segment '{segment}' not found.").alias("error"), "valid_segments")


def unknown_tools(names: DataFrame, column: str = "tool") -> DataFrame:
    """(tool, error) of the names that no tool has."""
    return names.filter(~F.col(column).isin(*TOOLS)).select(F.col(column).alias("tool"), F.concat(F.lit("unknown tool: "), F.col(column)).alias("error"))


def segment_benchmark_web(customers: DataFrame, segment: str) -> DataFrame:
    """The web tool's averages: null counts as 0, and all rows divide."""
    zero = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)))
    return customers.filter(F.col("segment") == segment).groupBy("segment").agg(
        F.count("*").alias("total"), js_round(zero("churn_probability") * 100).cast("long").alias("avg_churn_pct"), F.round(zero("uplift_score"), 4).alias("avg_uplift"), F.count_if(F.col("risk_tier") == "High Risk").alias("high_risk"), F.count_if(F.col("customer_type") == "Persuadable").alias("persuadable"),
    )


def churn_drivers(drivers: DataFrame, customer_id: str, n: int = 6) -> DataFrame:
    """(feature, value, effect, magnitude) of one customer's driver map, largest first."""
    e = drivers.filter(F.col("CustomerID") == str(customer_id)).select(F.explode("TopDrivers").alias("feature", "value"))
    size = F.abs("value")
    return (
        e.withColumn("effect", F.when(F.col("value") > 0, "increases churn risk").otherwise("decreases churn risk"))
        .withColumn("magnitude", F.when(size > 0.1, "strong").when(size > 0.05, "moderate").otherwise("weak"))
        .orderBy(F.desc(size), "feature")
        .limit(n)
    )


def roi(df: DataFrame, uplift: Column, clv: float = CLV, cost: float = COST) -> DataFrame:
    """Expected value, net ROI, ROI in percent, break-even uplift and verdict of every row."""
    value = uplift * clv
    net = value - cost
    return df.select(
        "customer_id", steady(value, 2).alias("expected_value"), steady(net, 2).alias("net_roi"), (F.lit(0.0) if cost <= 0 else steady(net / cost * 100, 1)).alias("roi_pct"),
        F.lit(round(cost / clv, 3) if clv > 0 else 0.0).alias("break_even_uplift"), F.when(net > 0, "positive").otherwise("negative").alias("verdict"),
    )


def _first(cases: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for p, v in cases:
        out = F.when(p, v) if out is None else out.when(p, v)
    return F.lit(default) if out is None else out.otherwise(default)


def playbook_match(df: DataFrame, risk: str) -> DataFrame:
    """Adds the JSON playbook's matched key and match type for a risk factor: the exact key, else most key words of over 3 letters (ties to the first), else the default."""
    q = F.translate(F.lower(F.col(risk)), " -", "__")
    keys = [k for k, _ in PLAYBOOK]
    scores = [(sum((q.contains(w).cast("int") for w in k.split("_") if len(w) > 3), F.lit(0)), k) for k in keys if k != "default"]
    best = F.greatest(*[s for s, _ in scores])
    exact = q.isin(keys)
    fuzzy = is_true(best > 0)
    key = F.when(exact, q).when(fuzzy, _first([(s == best, k) for s, k in scores], "default")).otherwise("default")
    out = df.withColumn("matched_key", key).withColumn("match_type", F.when(exact, "exact").when(fuzzy, "fuzzy").otherwise("default"))
    return out.withColumn("intervention_type", F.element_at(F.create_map(*[F.lit(x) for kv in PLAYBOOK for x in kv]), F.col("matched_key")))


def keyword_match(df: DataFrame, risk: str) -> DataFrame:
    """Adds the table playbook's intervention: the first row whose keyword is in the lower-cased text, else the default."""
    q = F.lower(F.col(risk))
    return df.withColumn("keyword", _first([(q.contains(k), k) for k, _ in KEYWORDS if k != "default"], "default")).withColumn("intervention_type", F.element_at(F.create_map(*[F.lit(x) for kv in KEYWORDS for x in kv]), F.col("keyword")))


def list_customers(customers: DataFrame, segment: str | None = None, tier: str | None = None, kind: str | None = None, top: int = 10) -> DataFrame:
    """The top rows by churn probability under optional filters, at most 20, with the count before the limit."""
    for c, v in (("segment", segment), ("risk_tier", tier), ("customer_type", kind)):
        customers = customers.filter(F.col(c) == v) if v else customers
    total = customers.agg(F.count("*").alias("total_matching"))
    rows = customers.orderBy(F.desc("churn_probability"), "customer_id").limit(min(int(top or 10), 20))
    return rows.crossJoin(F.broadcast(total)).select("customer_id", "segment", "risk_tier", "customer_type", F.bround("churn_probability", 3).alias("churn_probability"), "total_matching")


def past_interventions(actions: DataFrame, feedback: DataFrame, customer_id: str) -> DataFrame:
    mine = actions.filter(F.col("customer_id") == str(customer_id)).orderBy(F.desc("generated_at"), F.desc("id")).limit(10)
    return audit.with_latest(mine, feedback).select("id", "intervention_type", "generated_at", "outcome")


def success_rates(actions: DataFrame, feedback: DataFrame) -> DataFrame:
    known = actions.withColumn("intervention_type", F.coalesce("intervention_type", F.lit("Unknown")))
    return audit.summary(audit.with_latest(known, feedback), "intervention_type", "has_feedback")


def at_risk(customers: DataFrame, segment: str | None = None, limit: int = 10) -> DataFrame:
    c = customers.filter(F.col("risk_tier") == "High Risk")
    c = c.filter(F.col("segment") == segment) if segment else c
    return c.orderBy(F.desc_nulls_first("churn_probability"), "customer_id").limit(min(limit, 25)).select("customer_id", "segment", "churn_probability", "net_roi")


def revenue_at_risk(customers: DataFrame, clv: float = CLV) -> DataFrame:
    """Expected churners are rounded by segment and only then summed."""
    s = customers.groupBy("segment").agg(js_round(F.count("*") * F.round(F.avg("churn_probability"), 9)).cast("long").alias("expected_churners"))
    return s.agg(F.sum("expected_churners").alias("expected_churners"), F.sum(F.col("expected_churners") * clv).alias("revenue_at_risk"))


def unactioned_persuadables(customers: DataFrame, actions: DataFrame, limit: int = 10) -> DataFrame:
    """Of the 100 best Persuadables by ROI, those without any action; the order of the two steps matters."""
    best = customers.filter(F.col("customer_type") == "Persuadable").orderBy(F.desc_nulls_first("net_roi"), "customer_id").limit(100)
    return best.join(actions.select("customer_id").distinct(), "customer_id", "left_anti").orderBy(F.desc_nulls_first("net_roi"), "customer_id").limit(min(limit, 25)).select("customer_id", "segment", "net_roi")


def prompt(customers: DataFrame) -> DataFrame:
    """A deterministic prompt for every customer, from its fields."""
    text = F.format_string("Customer %s (%s, %s). Churn probability %.1f%%, uplift %.4f, net ROI $%.2f. Tenure %.0f, orders %d, days since last order %.0f, satisfaction %d of 5.", "customer_id", "segment", "customer_type", shown(F.col("churn_probability") * 100, 1), shown(F.col("uplift_score"), 4), shown(F.col("net_roi"), 2), "tenure", "order_count", "days_since_last_order", "satisfaction_score")
    return customers.select("customer_id", text.alias("prompt"))


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (lookup, segment_benchmark, segment_benchmark_web, churn_drivers, list_customers, past_interventions, success_rates, at_risk, revenue_at_risk, unactioned_persuadables)}


def execute_tool(name: str, *args, **kwargs) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"unknown tool: {name}")
    return TOOLS[name](*args, **kwargs)


def segment_revenue_at_risk(customers: DataFrame, segment: str, clv: float = CLV) -> DataFrame:
    """(segment, total, expected_churners, revenue_at_risk) of one segment; no row where nobody is in it."""
    s = customers.filter(F.col("segment") == segment).groupBy("segment").agg(F.count("*").alias("total"), js_round(F.count("*") * F.round(F.avg("churn_probability"), 9)).cast("long").alias("expected_churners"))
    return s.withColumn("revenue_at_risk", F.col("expected_churners") * clv)


def ranked_success_rates(actions: DataFrame, feedback: DataFrame, n: int = 5) -> DataFrame:
    """The intervention types with the most actions, first by total, then by name."""
    return success_rates(actions, feedback).orderBy(F.desc("total"), "intervention_type").limit(n)


TOOLS |= {f.__name__: f for f in (roi, playbook_match, keyword_match, segment_revenue_at_risk, ranked_success_rates)}


def tool_result(spark: SparkSession, name: str, *args, **kwargs) -> DataFrame:
    """A tool's result, or one row with an ``error``: for an unknown tool, missing or wrong arguments."""
    try:
        return execute_tool(name, *args, **kwargs)
    except KeyError:
        text = f"unknown tool: {name}"
    except (TypeError, ValueError) as e:
        text = f"{name}: {e}"
    return spark.createDataFrame([(text,)], "error string")
