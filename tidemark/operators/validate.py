"""Checks of raw tables and scoring requests."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_AT, LEAST_ROWS = 0.30, 100
RANGES = {"Tenure": (0, None), "CityTier": (1, 3), "WarehouseToHome": (0, None), "HourSpendOnApp": (0, None), "NumberOfDeviceRegistered": (1, None), "SatisfactionScore": (1, 5), "NumberOfAddress": (1, None), "Complain": (0, 1), "OrderAmountHikeFromlastYear": (0, None), "CouponUsed": (0, None), "OrderCount": (0, None), "DaySinceLastOrder": (0, None), "CashbackAmount": (0, None)}


def missing_rates(df: DataFrame) -> DataFrame:
    """(column, missing_rate) in one pass over the table."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return rates.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("column", "missing_rate"))


def validate(df: DataFrame, expected: list[str]) -> DataFrame:
    """The table itself; an error for missing columns or too few rows, a warning for columns with many nulls."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    row = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(expected)]).first()
    for i, c in enumerate(expected):
        if (row[f"m{i}"] or 0) > MISSING_AT:
            warnings.warn(f"column {c} has {row[f'm{i}']:.0%} missing values", stacklevel=2)
    if row["n"] < LEAST_ROWS:
        raise ValueError(f"only {row['n']} rows; at least {LEAST_ROWS} are needed")
    return df


def report(df: DataFrame, expected: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """(check, column, value, ok) of ``validate``'s checks as rows, in one pass: whether each expected column is there, its share of nulls, and the number of rows."""
    there = [c for c in expected if c in df.columns]
    one = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(there)])
    row = lambda check, column, value, ok: F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), value.cast("double").alias("value"), ok.alias("ok"))
    rows = [row("present", c, F.lit(float(c in there)), F.lit(c in there)) for c in expected]
    rows += [row("missing_rate", c, F.round(F.coalesce(f"m{i}", F.lit(0.0)), 6), F.coalesce(F.col(f"m{i}"), F.lit(0.0)) <= MISSING_AT) for i, c in enumerate(there)]
    rows.append(row("rows", None, F.col("n"), F.col("n") >= least))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_requests(df: DataFrame) -> DataFrame:
    """Adds ``errors``: the required fields that are missing or out of range; and ``valid``."""
    checks = []
    for name, (low, high) in RANGES.items():
        c = F.col(name) if name in df.columns else F.lit(None).cast("double")
        bad = c.isNull()
        bad = bad | (c < low) if low is not None else bad
        bad = bad | (c > high) if high is not None else bad
        checks.append(F.when(bad, F.lit(name)))
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def label_column(df: DataFrame, name: str = "churn") -> str:
    found = next((c for c in df.columns if c.strip().lower() == name), None)
    if found is None:
        raise ValueError(f"no {name} column")
    return found


def some_rows(df: DataFrame, what: str = "history") -> DataFrame:
    """The table itself; an error where it is empty."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df
