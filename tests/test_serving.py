"""Requests, configuration, replies, plans, audit rows, adapters' odd inputs, and tables written once."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import agent, audit, features, serving, validate
from tidemark.sources import stage


def test_tiers_of_requests_are_left_closed(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.6, 1.0, None)], "p double")
    assert [r[0] for r in df.select(serving.serving_tier(F.col("p"))).collect()] == ["Low Risk", "Medium Risk", "High Risk", "High Risk", None]


def test_requests_out_of_range_are_told_and_not_scored(spark):
    names = features.CHURN_NUMERIC
    fine = {c: 2.0 for c in names} | {"Complain": 0.0}
    rows = [fine, fine | {"SatisfactionScore": 10.0}, {**fine, "Tenure": None}]
    df = spark.createDataFrame([(str(i), *[r[c] for c in names]) for i, r in enumerate(rows)], "CustomerID string, " + ", ".join(f"{c} double" for c in names))
    got = {r["CustomerID"]: r for r in serving.score_requests(df, features.feature_stats(df.limit(1))).collect()}
    assert got["0"]["valid"] and 0 <= got["0"]["churn_probability"] <= 1 and got["0"]["customer_type"] in ("Lost Cause", "Sleeping Dog")
    assert got["1"]["errors"] == ["SatisfactionScore"] and got["2"]["errors"] == ["Tenure"] and got["1"]["churn_probability"] is None and got["2"]["risk_tier"] is None


def test_errors_of_tools_are_rows(spark):
    assert agent.tool_result(spark, "nothing").first()["error"] == "unknown tool: nothing"
    assert agent.tool_result(spark, "lookup").first()["error"].startswith("lookup: ")
    assert {"roi", "playbook_match"} <= agent.TOOLS.keys()


def test_a_provider_may_answer_badly_or_advise_against(spark):
    c = spark.createDataFrame([("1", "s", "Persuadable", 2.0), ("2", "s", "Persuadable", 1.0), ("3", "s", "Persuadable", None), ("4", "s", "Lost Cause", None)], "customer_id string, segment string, customer_type string, intervention_priority double")
    d = spark.createDataFrame([("1", [("Tenure", 0.5)]), ("2", [("Complain", -0.1)])], "CustomerID string, Drivers array<struct<feature:string,value:double>>")
    reply = lambda rows: rows.withColumn("reply", F.when(F.col("customer_id") == "1", '<think>x</think>{"do_not_intervene_reason": "no"}').when(F.col("customer_id") == "2", "sorry"))
    got = {r["customer_id"]: r for r in serving.displayed(serving.batch_plans(c, d, n=3, provider=reply)).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"]["display"].startswith("**No Intervention") and got["2"]["display"].startswith("Error") and got["3"]["error"]
    assert got["1"]["risk"] == "high Tenure" and got["2"]["risk"] == "low Complain"
    assert [r["customer_id"] for r in serving.candidates(c).collect()] == ["2", "1", "3"]
    assert len(serving.export_columns(serving.batch_plans(c, d)).columns) == 13


def test_malformed_maps_are_empty(spark):
    df = spark.createDataFrame([('{"a": 1.5}',), ("{oops",), (None,)], "j string")
    assert [r[0] for r in df.select(serving.numbers_of(F.col("j"))).collect()] == [{"a": 1.5}, {}, {}]


def test_audit_rows_are_appended_with_their_customer(spark, tmp_path):
    customers = spark.createDataFrame([("1", "s", 0.5, 0.1, 3.0)], "customer_id string, segment string, churn_probability double, uplift_score double, net_roi double")
    actions = spark.createDataFrame([(1, "1", "Discount Offer", [(1, "lookup")]), (2, "9", "Loyalty Reward", None), (3, "1", None, None)], "id long, customer_id string, intervention_type string, trace array<struct<round:int,tool:string>>")
    rows = serving.action_rows(actions, customers)
    assert rows.columns == serving.ACTIONS.names and rows.count() == 2
    audit.append(rows, str(tmp_path / "log"))
    got = {r["id"]: r for r in spark.read.schema(serving.ACTIONS).parquet(str(tmp_path / "log")).collect()}
    assert got["1"]["segment"] == "s" and got["1"]["agent_reasoning"] == '[{"round":1,"tool":"lookup"}]' and got["2"]["segment"] is None
    assert serving.new_ids(spark.range(5)).select("id").distinct().count() == 5


def test_telecom_rows_without_ids_are_numbered(spark):
    df = spark.createDataFrame([("yes", i % 7, float(i % 5)) for i in range(50)], "Churn string, Handsets int, MonthlyRevenue double")
    got = features.telecom_clean(df)
    assert sorted(int(r["CustomerID"]) for r in got.collect()) == list(range(50)) and features.telecom(got).count() == 50


def test_payments_and_reviews_of_an_order(spark):
    pay = spark.createDataFrame([(1, 10.0, 2, "b"), (1, 5.0, 4, "a"), (2, None, None, None)], "order_id int, payment_value double, payment_installments int, payment_type string")
    rev = spark.createDataFrame([(1, 7, 5, "2018-01-02"), (1, 8, 1, None)], "order_id int, review_id int, review_score int, answered_at string")
    got = {r["order_id"]: r for r in features.order_inputs(spark.createDataFrame([(1,), (2,), (3,)], "order_id int"), pay, rev).collect()}
    assert tuple(got[1])[1:] == (15.0, 3.0, "a", 1) and tuple(got[2])[1:] == (0.0, None, "credit_card", None) and got[3]["payment_type"] is None


def test_medians_of_all_numbers_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1, 2.0, None), ("y", None, None, None), ("z", 3, 4.0, None)], "CustomerID string, a int, b double, c double")
    assert {tuple(r) for r in features.impute_all(df).select("CustomerID", "a", "b").collect()} == {("x", 1, 2.0), ("y", 2, 3.0), ("z", 3, 4.0)}
    with pytest.raises(ValueError):
        validate.some_rows(df.limit(0))
    assert validate.some_rows(df) is df


def test_a_table_is_built_once(spark):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert stage.staged(spark, "somewhere", "t", build).count() == stage.staged(spark, "somewhere", "t", build).count() == 3 and len(built) == 1
    stage.forget("somewhere")
    assert stage.staged(spark, "somewhere", "t", build).count() == 3 and len(built) == 2


def provider_case(spark):
    c = spark.createDataFrame([(str(i), "s", "Persuadable", float(i), 0.5, 0.1, 3.0) for i in range(4)], "customer_id string, segment string, customer_type string, intervention_priority double, churn_probability double, uplift_score double, net_roi double")
    d = spark.createDataFrame([(str(i), [("Tenure", 0.5)]) for i in range(4)], "CustomerID string, Drivers array<struct<feature:string,value:double>>")
    return c, d, spark.createDataFrame([(str(i), f"q{i}") for i in range(4)], "customer_id string, prompt string")


def counted(folder, text):
    """How often a text has been asked, this time included; tasks are other processes."""
    import os

    n = sum(f.startswith(text + "-") for f in os.listdir(folder)) + 1
    open(f"{folder}/{text}-{n}", "w").close()
    return n


def test_a_provider_is_asked_up_to_three_times(spark, tmp_path):
    folder = str(tmp_path)
    full = '```json\n{"intervention_type": "Discount Offer", "channel": "SMS", "timing": "Immediate", "primary_risk_reason": "r", "customer_receptivity": "good", "message_framing": "m", "intervention_cost_estimate": "Low", "expected_outcome": "o", "confidence": "High", "do_not_intervene_reason": null}\n```'

    def call(text):
        n = counted(folder, text)
        if text == "q0":
            if n < 3:
                raise serving.RateLimited
            return full
        if text == "q1":
            return full if n == 2 else "no json"
        if text == "q2":
            return f"never {n}"
        raise ConnectionError("down")

    c, d, q = provider_case(spark)
    plans = serving.batch_plans(c, d, provider=serving.asking(call, tasks=2, per_second=1000, wait=0.01), questions=q)
    got = {r["customer_id"]: r for r in serving.displayed(plans).collect()}
    assert set(serving.PLAN_KEYS) | {"error", "raw_response"} <= set(plans.columns)
    for i in "01":
        assert got[i]["error"] is None and got[i]["raw_response"] is None and got[i]["confidence"] == "High" and got[i]["net_roi"] == 3.0
        assert got[i]["display"].split("\n")[2] == "**Cost:** Low | **Confidence:** High" and "> m" in got[i]["display"] and got[i]["display"].endswith("**Expected Outcome:** o")
    assert got["2"]["error"].startswith("JSON parse error") and got["2"]["raw_response"] == "never 3" and got["2"]["intervention_type"] is None
    assert got["3"]["error"] == "down" and got["3"]["display"] == "Error generating action: down"
    plans.count()  # reading again asks nobody
    assert sorted(f.split("-")[0] for f in __import__("os").listdir(folder)) == ["q0"] * 3 + ["q1"] * 2 + ["q2"] * 3 + ["q3"]


def test_a_provider_that_is_always_limited_gives_errors_and_calls_are_paced(spark, tmp_path):
    import time

    def call(text):
        raise serving.RateLimited

    c, d, q = provider_case(spark)
    began = time.monotonic()
    got = serving.batch_plans(c, d, provider=serving.asking(call, tasks=1, per_second=2, attempts=2, wait=0.05), questions=q).collect()
    assert {r["error"] for r in got} == {"Max retries exceeded."} and time.monotonic() - began >= 1.5


def test_a_changed_playbook_changes_answers(spark, monkeypatch):
    from tidemark.operators import playbook

    df = spark.createDataFrame([(1, "Low SATISFACTION and Tenure"), (2, "tenure"), (3, "nothing"), (4, None)], "id int, t string")
    seeds = playbook.seeds(spark)
    get = lambda table: {r["id"]: (r["keyword"], r["intervention"]) for r in playbook.keyword_match(df, "t", table).collect()}
    assert get(seeds) == {1: ("satisfaction", "Proactive Support Call"), 2: ("tenure", "Loyalty Reward"), 3: ("default", "Personalized Content"), 4: ("default", "Personalized Content")}
    other = seeds.filter("risk_factor_keyword <> 'default'").withColumn("position", F.when(F.col("risk_factor_keyword") == "tenure", 0).otherwise(F.col("position"))).withColumn("intervention", F.upper("intervention"))
    assert get(other)[1] == ("tenure", "LOYALTY REWARD") and get(other)[3] == (None, None)
    monkeypatch.setattr(playbook, "AUTOMATON_BYTES", 20)  # several automata
    assert get(seeds) == get(seeds.repartition(3)) and get(seeds)[1][0] == "satisfaction"
    assert get(seeds.limit(0))[1] == (None, None)


def test_tables_of_keys_match_as_the_fixed_ones(spark):
    from tidemark.operators import playbook

    df = spark.createDataFrame([("high SupportRiskScore",), ("high foo",), ("low foo",), ("low stickiness",), ("low-cashback or ordercount",), (None,), ("cashback cashback ordercount supportriskscore",)], "r string")
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(agent.PLAYBOOK)], "position int, key string, intervention_type string")
    want = {r["r"]: (r["matched_key"], r["match_type"], r["intervention_type"]) for r in agent.playbook_match(df, "r").collect() if r["r"]}
    got = {r["r"]: (r["matched_key"], r["match_type"], r["intervention_type"]) for r in playbook.key_match(df, "r", table).collect()}
    assert got.pop(None) == ("default", "default", "Loyalty Reward") and got == want


def test_prompts_keep_the_sign_of_small_negatives(spark):
    c = spark.range(1).select(F.lit("1").alias("customer_id"), F.lit("s").alias("segment"), *[F.lit("x").alias(n) for n in ("customer_type", "risk_tier")], F.lit(-0.00003).alias("uplift_score"), F.lit(-0.001).alias("net_roi"), *[F.lit(1.0).alias(n) for n in ("churn_probability", "tenure", "days_since_last_order", "hour_spend_on_app", "cashback_amount")], *[F.lit(1).alias(n) for n in ("satisfaction_score", "complain", "order_count")])
    d = spark.createDataFrame([("1", [("Tenure", 0.5)])], "CustomerID string, Drivers array<struct<feature:string,value:double>>")
    assert "uplift -0.0000, net ROI $-0.00." in agent.prompt(c).first()["prompt"] and "Uplift -0.0000. Net ROI $-0.00." in serving.prompts(c, d).first()["prompt"]
    assert "uplift 0.0000, net ROI $0.00." in agent.prompt(c.withColumns({"uplift_score": F.lit(0.00003), "net_roi": F.lit(0.0)})).first()["prompt"]
