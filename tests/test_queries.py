"""Every retention query against its SQL in DuckDB, and the learned stages by their properties."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import agent, audit, dashboard, metrics, scoring
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (str, bool, int, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_learned_stages(spark):
    n = registry.QUERIES["customer_features"](spark, SF).count()
    got = registry.QUERIES["kmeans_segments"](spark, SF)
    assert got.count() == n and got.select("RawSegment").distinct().count() == got.select("Segment").distinct().count() == 5
    p = registry.QUERIES["gbt_segment_scores"](spark, SF)
    assert p.count() == n and p.filter("ChurnProbability < 0 or ChurnProbability > 1").count() == 0
    u = registry.QUERIES["uplift_t_s"](spark, SF)
    assert u.count() == n and u.filter("abs(UpliftScore) > 1").count() == 0


def test_projection_and_memberships(spark):
    n = registry.QUERIES["customer_features"](spark, SF).count()
    assert registry.QUERIES["pca_embedding"](spark, SF).count() == n
    g = registry.QUERIES["gmm_soft"](spark, SF)
    assert g.count() == n and g.filter(F.abs(sum((F.col(f"GMM_Prob_Seg{i}") for i in range(5)), F.lit(-1.0))) > 1e-6).count() == 0


def test_agreement_of_labels(spark):
    df = spark.createDataFrame([(i, i % 3, (i + 1) % 3, i % 2) for i in range(60)], "id int, a int, b int, c int")
    assert metrics.adjusted_rand(df, "a", "a").first()[0] == 1.0 and metrics.adjusted_rand(df, "a", "b").first()[0] == 1.0 and abs(metrics.adjusted_rand(df, "a", "c").first()[0]) < 0.1


def test_scores_of_one_class(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 1)], "s double, y int")
    assert tuple(metrics.auc_ap_brier(df, "s", "y").first())[:2] == (0.5, 0.0)


def test_histogram_counts_unknowns_last(spark):
    df = spark.createDataFrame([("s", p) for p in (0.0, 0.05, 0.1, 0.999, 1.0, None)], "segment string, churn_probability double")
    assert [tuple(r) for r in dashboard.histogram(df).collect()] == [(0, 2), (1, 1), (9, 3)]


def test_average_ranks(spark):
    df = spark.createDataFrame([(i, "Persuadable", u) for i, u in enumerate((0.4, 0.1, 0.1, 0.05))] + [(9, "Lost Cause", 0.9)], "CustomerID int, CustomerType string, UpliftScore double")
    got = {r["CustomerID"]: r["InterventionPriority"] for r in scoring.intervention_roi(df).collect()}
    assert got == {0: 1.0, 1: 2.5, 2: 2.5, 3: 4.0, 9: None}


def test_feedback_fans_out_or_the_last_wins(spark):
    a = spark.createDataFrame([(1, "x")], "id long, intervention_type string")
    f = spark.createDataFrame([(5, 1, "churned", "2024-01-01"), (6, 1, "retained", "2024-01-02")], "id long, retention_action_id long, outcome string, logged_at string")
    assert audit.summary(audit.with_feedback(a, f), "intervention_type").first()["total"] == 2
    assert audit.with_latest(a, f).first()["outcome"] == "retained"


def test_best_persuadables_all_actioned(spark):
    c = spark.range(150).select(F.col("id").cast("string").alias("customer_id"), F.lit("s").alias("segment"), F.lit("Persuadable").alias("customer_type"), (1000 - F.col("id")).cast("double").alias("net_roi"))
    acted = spark.range(100).select(F.col("id").cast("string").alias("customer_id"))
    assert agent.unactioned_persuadables(c, acted).count() == 0


def test_playbook(spark):
    df = spark.createDataFrame([("high SupportRiskScore",), ("high foo",), ("low foo",), ("low stickiness",)], "r string")
    got = [(r["match_type"], r["matched_key"]) for r in agent.playbook_match(df, "r").collect()]
    assert got == [("exact", "high_supportriskscore"), ("fuzzy", "high_supportriskscore"), ("default", "default"), ("exact", "low_stickiness")]
    with pytest.raises(KeyError):
        agent.execute_tool("nothing")


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "id string, v int, updated_at int")
    new = spark.createDataFrame([("b", 3, 2), ("c", 4, 2)], "id string, v int, updated_at int")
    assert sorted((r["id"], r["v"]) for r in audit.upsert(old, new, "id").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r["id"] for r in audit.insert_missing(old, new, "id").collect()] == ["c"]
    path = str(tmp_path / "log")
    audit.append(old, path), audit.append(new, path)
    assert spark.read.parquet(path).count() == 4
    audit.truncate(spark.read.parquet(path), str(tmp_path / "other"))
    assert spark.read.schema(old.schema).parquet(str(tmp_path / "other")).count() == 0
    audit.export_plans(old, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_entry_and_streaming(spark, tmp_path):
    import __spark_entry__

    from tidemark.streaming import audit_stream

    assert __spark_entry__.entry(spark).count() >= 1 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    rows = spark.sql("SELECT id, id AS retention_action_id, IF(id % 2 = 0, 'retained', 'churned') AS outcome, TIMESTAMP '2024-01-01 10:00:00' + make_interval(0, 0, 0, CAST(id DIV 5 AS INT)) AS logged_at FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    q = audit_stream.daily_outcomes(audit_stream.read_feedback(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("outcomes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM outcomes").first()[0] == 20


def test_playbook_file(spark, tmp_path):
    from tidemark.sources import tables

    (tmp_path / "p.json").write_text('{"low_x": {"intervention_type": "A", "channel": "Email", "matched_features": ["X"]}}')
    got = tables.load_playbook(spark, str(tmp_path / "p.json")).first()
    assert got["key"] == "low_x" and got["matched_features"] == ["X"]
    assert tables.load_playbook(spark, str(tmp_path / "none.json")).count() == 0
    assert tables.pick_csv(["b.csv", "a_holdout.csv"]) == "b.csv" and tables.pick_csv(["z.csv", "train.csv"]) == "train.csv"
