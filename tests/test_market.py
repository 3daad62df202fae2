"""The marketplace's six files to features, and what happens without them."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import market, serving
from tidemark.sources import stage, tables

FILES = {
    "customers": "customer_id,customer_unique_id,customer_state\nc1,p1,SP\nc2,p1,SP\nc3,p2,DF\nc4,p3,AC\nc5,p4,SP\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp\no1,c1,delivered,2017-01-01 10:00:00\no2,c2,delivered,2018-02-01 10:00:00\no3,c3,delivered,2017-12-30 12:00:00\no4,c4,delivered,2017-06-01 00:00:00\no5,c5,canceled,2017-06-01 00:00:00\n",
    "items": "order_id,order_item_id,product_id,seller_id,price,freight_value\no1,1,a,s1,10.0,2.0\no1,2,b,s2,20.0,4.0\no1,3,b,s2,20.0,6.0\no3,1,a,s1,5.0,1.0\n",
    "payments": "order_id,payment_type,payment_installments,payment_value\no1,voucher,1,30.0\no1,boleto,3,10.0\no1,voucher,2,16.0\no3,boleto,1,6.0\n",
    "reviews": "review_id,order_id,review_score,review_answer_timestamp\nr1,o1,5,2017-01-05 00:00:00\nr2,o1,1,2017-01-09 00:00:00\n",
    "products": "product_id,product_category_name\na,toys\nb,books\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / tables.MARKETPLACE[name]).write_text(text)
    return tmp_path


def test_six_files_to_features(spark, folder):
    got = {r["CustomerID"]: r for r in market.marketplace_features(tables.load_marketplace(spark, str(folder))).collect()}
    assert set(got) == {"p1", "p2", "p3"}
    a, b, c = got["p1"], got["p2"], got["p3"]
    assert (a["Churn"], b["Churn"], c["Churn"]) == (0, 1, 1) and (a["CityTier"], b["CityTier"], c["CityTier"]) == (1, 2, 3)
    assert (a["Complain"], a["SatisfactionScore"], b["SatisfactionScore"]) == (1, 1, 3)
    assert (a["CouponUsed"], b["CouponUsed"], c["CouponUsed"]) == (1, 0, 0) and (a["HourSpendOnApp"], c["HourSpendOnApp"]) == (3, 0)
    assert (a["CashbackAmount"], b["CashbackAmount"], c["CashbackAmount"]) == (56, 6, 0) and a["WarehouseToHome"] == 4 and c["WarehouseToHome"] == 2.5
    assert [x["PreferredPaymentMode"] for x in (b, c, a)] == [0, 1, 2] and [x["PreferedOrderCat"] for x in (a, c, b)] == [0, 1, 2] and a["Gender"] == a["MaritalStatus"] == a["PreferredLoginDevice"] == 0
    assert (a["Tenure"], b["Tenure"], b["DaySinceLastOrder"]) == (363, 1, 0)


def test_missing_and_damaged_files(spark, folder):
    (folder / tables.MARKETPLACE["reviews"]).unlink()
    with pytest.raises(FileNotFoundError):
        tables.load_marketplace(spark, str(folder))
    (folder / "x.parquet").write_text("no table")
    with pytest.raises(RuntimeError):
        tables.read_table(spark, str(folder / "x.parquet"))
    with pytest.raises(FileNotFoundError):
        stage.load_stage(spark, str(folder / "churn_models"))


def test_no_history_is_an_error(spark, folder):
    t = tables.load_marketplace(spark, str(folder))
    with pytest.raises(ValueError):
        market.marketplace_features(t | {"orders": t["orders"].filter(F.col("order_id") == "o2")})


def test_prompts_tell_the_profile(spark):
    c = spark.range(1).select(F.lit("1").alias("customer_id"), F.lit("s").alias("segment"), *[F.lit("x").alias(n) for n in ("customer_type", "risk_tier")], *[F.lit(1.0).alias(n) for n in ("churn_probability", "uplift_score", "net_roi", "tenure", "days_since_last_order", "hour_spend_on_app", "cashback_amount")], *[F.lit(1).alias(n) for n in ("satisfaction_score", "complain", "order_count")])
    d = spark.createDataFrame([("1", [("Tenure", 0.5)])], "CustomerID string, Drivers array<struct<feature:string,value:double>>")
    p = spark.createDataFrame([("s", 2.5, 7)], "Segment string, Tenure double, Count int")
    assert serving.prompts(serving.with_profile(c, p), d).first()["prompt"].endswith(" Drivers: Tenure 0.5000. Segment profile: Tenure 2.5, Count 7.")
    assert serving.prompts(c, d).first()["prompt"].endswith(" Drivers: Tenure 0.5000.")
