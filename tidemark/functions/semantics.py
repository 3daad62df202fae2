"""Small column functions whose edge cases matter: nulls, rounding, tiers, quadrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the retention rules.
LOW_TIER, MEDIUM_TIER = 0.3, 0.6
UPLIFT_AT, CHURN_AT = 0.05, 0.30
CLV, COST = 500.0, 15.0
SEGMENTS = ["Champions", "Loyal Customers", "At-Risk", "Price Sensitive", "Lapsed"]


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep nulls (bare greatest/least would turn them into a bound)."""
    out = c
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(c.isNotNull(), out)


def is_true(p: Column) -> Column:
    """A comparison with null is false."""
    return F.coalesce(p, F.lit(False))


def risk_tier(p: Column) -> Column:
    """Right-closed tiers; null stays null."""
    return F.when(p.isNull(), None).when(p <= LOW_TIER, "Low Risk").when(p <= MEDIUM_TIER, "Medium Risk").otherwise("High Risk")


def customer_type(uplift: Column, churn: Column, uplift_at: float = UPLIFT_AT, churn_at: float = CHURN_AT) -> Column:
    """The four intervention quadrants; unknown scores count as low."""
    helps, leaves = is_true(uplift >= uplift_at), is_true(churn >= churn_at)
    return F.when(helps & leaves, "Persuadable").when(helps, "Sure Thing").when(leaves, "Lost Cause").otherwise("Sleeping Dog")


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def yes_no(c: Column) -> Column:
    return is_true(F.lower(F.trim(c)).isin("1", "yes", "true")).cast("int")


def first_digits(c: Column, default: float) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("double"), F.lit(default))


def mapped(c: Column, values: dict, default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(default))


def with_default(df: DataFrame, name: str, default: object) -> Column:
    """A column if it is there, else a constant."""
    return F.col(name) if name in df.columns else F.lit(default)


def whole_days(start: Column, end: Column) -> Column:
    """Full days of a duration, not midnights crossed."""
    return F.timestamp_diff("DAY", start, end)


def steady(c: Column, digits: int) -> Column:
    """Rounded after a nudge of 0.0031 of the last digit, so that float noise can't decide a tie."""
    return F.round(c + float(f"3.1e-{digits + 3}"), digits)


def shown(c: Column, digits: int) -> Column:
    """As ``steady``, for text: a negative value that rounds to zero keeps its sign, as SQL's and C's ``printf`` show it."""
    out = steady(c, digits)
    return F.when((c + float(f"3.1e-{digits + 3}") < 0) & (out == 0), F.lit(-0.0)).otherwise(out)


def r6(c: Column) -> Column:
    return steady(c, 6)
