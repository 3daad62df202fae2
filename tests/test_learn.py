"""Learned stages do the reference's whole work by default."""

import inspect
import pickle

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting, forest, learn
from tidemark.plans import batch, registry
from tidemark.sources.stage import load_stage

SF = "/root/testdata/sf0.001"


def default(f, name):
    return inspect.signature(f).parameters[name].default


def test_sweep_has_all_ks_and_davies_bouldin(spark, monkeypatch):
    jobs = []
    lloyd = learn.lloyd
    monkeypatch.setattr(learn, "lloyd", lambda x, j, iterations: jobs.append((j, iterations)) or lloyd(x, j, iterations))
    rows = registry.QUERIES["k_sweep"](spark, SF).collect()
    assert [r["k"] for r in rows] == list(range(2, 9)) and jobs == [([(k, 42 + i, None) for k in range(2, 9) for i in range(10)], 300)]
    assert all(r["davies_bouldin"] > 0 and r["inertia"] > 0 and -1 <= r["silhouette"] <= 1 for r in rows)
    assert [r["inertia"] for r in rows] == sorted((r["inertia"] for r in rows), reverse=True)


def test_bootstrap_rests_on_a_hundred_resamples(spark):
    got = learn.bootstrap_agreement(registry.QUERIES["customer_features"](spark, SF))
    assert default(learn.bootstrap_stability, "n") == 100 and default(learn.bootstrap_stability, "seeds") == 5 and got.count() == 100
    out = registry.QUERIES["bootstrap_stability"](spark, SF).first()
    aris = [r["ari"] for r in got.collect()]
    assert abs(out["mean"] - sum(aris) / 100) < 1e-9 and out["min"] == min(aris) and out["max"] == max(aris) and out["grade"]


def test_fits_have_the_size_of_the_reference():
    assert (default(learn.best_kmeans, "seeds"), default(learn.best_kmeans, "iterations"), default(learn.kmeans_segments, "seeds"), default(learn.kmeans_segments, "iterations")) == (20, 500, 20, 500)
    assert (default(learn.gmm_soft, "seeds"), default(learn.gmm_soft, "iterations")) == (5, 200)
    assert (default(learn.churn_models, "rounds"), default(learn.churn_models, "depth"), default(learn.churn_models, "cv_rounds"), default(learn.churn_models, "folds")) == (500, 6, 100, 3)
    assert (default(learn.segment_scores, "rounds"), default(learn.segment_scores, "depth")) == (500, 6)
    assert (default(learn.uplift_scores, "rounds"), default(learn.uplift_scores, "depth")) == (200, 4)


def test_all_starts_at_once_are_those_of_plain_lloyd(spark):
    """Each restart and resample ends where a plain numpy K-means from the same centres and weights does."""
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 3)) + 3 * rng.integers(0, 3, 300)[:, None]
    x = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], "CustomerID string, x array<double>").repartition(5)
    ids = {r[0]: r[1] for r in x.selectExpr("CustomerID", "xxhash64(CustomerID)").collect()}
    h = np.array([ids[str(i)] for i in range(300)]).view(np.uint64)
    jobs = [(3, 1, None), (4, 2, None), (3, 1, 0), (3, 5, 7)]
    start = learn.lloyd(x, jobs, 0)
    for (k, _, draw), (c, _), (got, _) in zip(jobs, start, learn.lloyd(x, jobs, 100, tolerance=0.0)):
        w = learn._times(h, draw, 0.8)
        for _ in range(100):
            near = ((m[:, None] - c) ** 2).sum(-1).argmin(1)
            c = np.array([np.average(m[near == j], axis=0, weights=w[near == j]) if w[near == j].sum() else c[j] for j in range(k)])
        assert np.allclose(c, got)
    assert abs(learn._times(rng.integers(0, 1 << 63, 20000).astype(np.uint64), 3, 0.8).mean() - 0.8) < 0.03


def test_all_mixtures_at_once_are_those_of_one_by_one(spark, monkeypatch):
    """Each seed ends where MLlib's fit from the same start does; five seeds cost as many passes as the slowest of them."""
    from types import SimpleNamespace

    from pyspark.mllib.clustering import GaussianMixture
    from pyspark.mllib.linalg import Matrices, Vectors

    rng = np.random.default_rng(3)
    m = np.column_stack((rng.normal(size=(400, 2)) + 4 * rng.integers(0, 2, 400)[:, None], rng.integers(0, 2, 400), np.zeros(400)))
    m[:2, 0] = 80, -90  # rows far from all components
    x = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], "CustomerID string, x array<double>").repartition(5)
    passes, total = [], learn._total
    monkeypatch.setattr(learn, "_total", lambda *a, **b: passes.append(1) or total(*a, **b))
    start, seeds = learn.mixtures(x, 2, [1, 2, 3, 4, 5], 0), [1, 2, 3, 4, 5]
    got = learn.mixtures(x, 2, seeds, 8, tolerance=0.0)
    assert len(passes) == 8
    for ((w, mean, cov), _), ((w2, mean2, cov2), likelihood) in zip(start, got):
        components = [SimpleNamespace(mu=Vectors.dense(a), sigma=Matrices.dense(4, 4, b.ravel())) for a, b in zip(mean, cov)]
        want = GaussianMixture.train(spark.sparkContext.parallelize([Vectors.dense(v) for v in m], 3), 2, 0.0, 8, initialModel=SimpleNamespace(k=2, weights=w.tolist(), gaussians=components))
        assert np.allclose(want.weights, w2, atol=1e-9) and np.isfinite(likelihood)
        for i, g in enumerate(want.gaussians):
            assert np.allclose(g.mu.toArray(), mean2[i], atol=1e-8) and np.allclose(g.sigma.toArray(), cov2[i], atol=1e-8)


def test_memberships_are_the_densities_shares(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), *map(float, v + 5 * (i % 2))) for i, v in enumerate(rng.normal(size=(200, len(learn.CLUSTERING))))]
    df = spark.createDataFrame(rows, "CustomerID string, " + ", ".join(f"{c} double" for c in learn.CLUSTERING))
    got = learn.gmm_soft(df, k=2, seeds=3, iterations=30).collect()
    by = {0: set(), 1: set()}
    for r in got:
        assert abs(r[2] + r[3] - 1) < 1e-9 and r["GMM_Segment"] == int(r[3] > r[2])
        by[int(r["CustomerID"]) % 2].add(r["GMM_Segment"])
    assert len(got) == 200 and len(by[0]) == len(by[1]) == 1 and by[0] != by[1]
    assert learn.gmm_soft(df.limit(0), k=2).collect() == [] and learn.gmm_soft(df.limit(1), k=2, seeds=2).count() == 1


def test_boosting_learns_and_scores_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=1500) * 0.3 > 0).astype(float)
    m = boosting.fit(x[:1000], y[:1000], np.ones(1000), 200, 4)
    auc, ap, brier = boosting.quality(y[1000:], boosting.predict(m, x[1000:]))
    assert auc > 0.9 and ap > 0.9 and brier < 0.15 and set(np.argsort(-m["gain"])[:3]) == {0, 1, 2}
    pairs = [(p > q) + 0.5 * (p == q) for p in (0.2, 0.7, 0.7) for q in (0.7, 0.1)]
    assert abs(boosting.quality(np.array([1, 1, 1, 0, 0.0]), np.array([0.2, 0.7, 0.7, 0.7, 0.1]))[0] - sum(pairs) / 6) < 1e-12
    assert boosting.quality(np.ones(4), np.ones(4) / 2) == (0.5, 0.0, 0.25)


def test_churn_models_have_figures_and_small_segments_none(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), "a" if i < 400 else "b" if i < 430 else "c", int(v[0] + 0.3 * rng.normal() > 0) if i < 430 else 1, *map(float, v)) for i, v in enumerate(rng.normal(size=(530, len(learn.CHURN_FEATURES))))]
    df = spark.createDataFrame(rows, "CustomerID string, Segment string, Churn int, " + ", ".join(f"{c} double" for c in learn.CHURN_FEATURES))
    models = learn.churn_models(df, rounds=60, depth=3, cv_rounds=20).persist()
    r = models.collect()
    assert [x["Segment"] for x in r] == ["a"] and r[0]["train_auc"] > 0.85 and r[0]["holdout_auc"] > 0.85 and r[0]["cv_auc"] > 0.85
    top = learn.top_importances(models, "a").collect()
    assert top[0]["feature"] == learn.CHURN_FEATURES[0] and top[0]["importance"] == 1.0 and len(top) == 15
    got = learn.segment_scores(df, models=models)
    assert got.count() == 530 and {tuple(x) for x in got.groupBy("Segment").agg(F.count("ChurnProbability")).collect()} == {("a", 400), ("b", 0), ("c", 0)}
    assert {x["Segment"] for x in learn.model_drivers(df, models).collect()} == {"a"}
    assert learn.run_metrics(models).count() == 8 and 0.5 < r[0]["cv_ap"] <= 1 and list(r[0]["features"]) == learn.CHURN_FEATURES and len(learn.CHURN_FEATURES) == 26


def labelled(spark, n=1600, segments=("a", "b"), seed=4):
    """Rows whose churn hangs on two features and a category's code; the segments differ in sign and in size."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(learn.CHURN_FEATURES)))
    code = learn.CHURN_FEATURES.index("Gender")
    x[:, code] = rng.integers(0, 3, n)
    seg = np.where(rng.random(n) < 0.8, segments[0], segments[-1])
    score = np.where(seg == "a", 1, -1) * x[:, 0] + 1.5 * (x[:, code] == 1) - 1 + 0.7 * rng.normal(size=n)
    rows = [(str(i), str(seg[i]), int(score[i] > 0), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "CustomerID string, Segment string, Churn int, " + ", ".join(f"{c} double" for c in learn.CHURN_FEATURES)).repartition(6)


def test_a_fit_on_all_rows_is_as_good_as_that_of_one_task(spark):
    df = labelled(spark)
    how = {"rounds": 24, "depth": 3, "cv_rounds": 6}
    one = {r["Segment"]: r for r in learn.churn_models(df, **how).collect()}
    every = learn.churn_models(df, most=None, **how).persist()
    got = {r["Segment"]: r for r in every.collect()}
    assert set(got) == set(one) == {"a", "b"}
    for s in got:
        assert got[s]["rows"] == one[s]["rows"] and list(got[s]["features"]) == learn.CHURN_FEATURES
        assert abs(got[s]["holdout_auc"] - one[s]["holdout_auc"]) < 0.02 and abs(got[s]["train_auc"] - one[s]["train_auc"]) < 0.02 and abs(got[s]["cv_auc"] - one[s]["cv_auc"]) < 0.03
        assert {learn.CHURN_FEATURES[i] for i in np.argsort(-np.array(got[s]["importance"]))[:2]} == {"Gender", learn.CHURN_FEATURES[0]}
    assert learn.segment_scores(df, models=every).filter("ChurnProbability is null").count() == 0


def test_sums_over_tasks_give_the_trees_of_one_task(spark):
    """With the same bins, level by level fits are those of plain numpy, across written margins and folds."""
    rng = np.random.default_rng(8)
    n = 500
    x = rng.integers(0, 9, (n, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 4) + rng.normal(size=n) > 8).astype(int)
    w, fold = rng.choice([1.0, 2.5], n), rng.integers(0, 2, n)
    df = spark.createDataFrame([("g", int(y[i]), float(w[i]), int(fold[i]), x[i].tolist()) for i in range(n)], "s string, y int, weight double, fold int, x array<double>").repartition(5)
    kept = forest.KEPT
    try:
        forest.KEPT = 2
        got = forest.fit_all(df, "s", "y", 5, 3, folds=2, fold_rounds=3)
    finally:
        forest.KEPT = kept
    assert set(got) == {("g", None), ("g", 0), ("g", 1)}
    for (_, out), m in got.items():
        use = fold != out if out is not None else np.ones(n, bool)
        cuts = m["cuts"]
        old = boosting.edges
        try:
            boosting.edges = lambda _: cuts  # noqa: B023
            want = boosting.fit(x[use], y[use].astype(float), w[use], 5 if out is None else 3, 3)
        finally:
            boosting.edges = old
        assert np.allclose(boosting.predict(m, x), boosting.predict(want, x)) and np.allclose(m["gain"], want["gain"]) and (m["splits"] == want["splits"]).all()
    assert forest.fit_all(df.limit(0), "s", "y", 5, 3) == {} and forest.fit_all(df.withColumn("y", F.lit(1)), "s", "y", 2, 2) == {}


def test_large_segments_are_fitted_on_all_their_rows(spark):
    """Importances come from every labelled row, one segment in a task or all in passes: both give the same model, and a reading from about 50,000 rows doesn't."""
    n = 70_000
    x = [F.rand(i) for i in range(len(learn.CHURN_FEATURES))]
    df = spark.range(n, numPartitions=4).select(F.col("id").cast("string").alias("CustomerID"), F.lit("Champions").alias("Segment"), *[F.round(c, 3).alias(name) for c, name in zip(x, learn.CHURN_FEATURES)])
    a, b = learn.CHURN_FEATURES[:2]
    df = df.withColumn("Churn", F.when(F.col("CustomerID") % 9 != 0, (F.col(a) + F.col(b) * F.col(b) + F.rand(99) > 1.4).cast("int"))).persist()
    labelled_rows = df.filter("Churn is not null").count()
    how = {"rounds": 3, "depth": 3, "cv_rounds": 2}
    one, every = (learn.churn_models(df, most=most, **how).persist() for most in (learn.TASK_ROWS, 1000))
    r, q = one.first(), every.first()
    assert labelled_rows > learn.FIT_ROWS and r["rows"] == q["rows"] == labelled_rows
    m, k = pickle.loads(r["model"]), pickle.loads(q["model"])
    assert all(np.allclose(u, v, rtol=1e-12) for u, v in zip(m["cuts"], k["cuts"], strict=True)) and (m["splits"] == k["splits"]).all()
    assert np.allclose(m["leaves"], k["leaves"]) and np.allclose(r["importance"], q["importance"])
    assert all(abs(r[f] - q[f]) < 1e-6 for f in learn.FIGURES)
    top = learn.top_importances(one, "Champions").collect()
    assert len(top) == 15 and {t["feature"] for t in top[:2]} == {a, b} and [t["feature"] for t in top] == [t["feature"] for t in learn.top_importances(every, "Champions").collect()]
    df.unpersist()


def test_drivers_rest_on_rows_that_a_sample_would_leave_out(spark):
    """A feature that tells churn only in rows whose hash lies above a sample's threshold is the first driver of these rows."""
    a, b = learn.CHURN_FEATURES[:2]
    tail = F.shiftrightunsigned(F.xxhash64("CustomerID", F.lit(42)), 11) / F.lit(float(1 << 53)) >= 0.82
    df = spark.range(60_000, numPartitions=4).select(F.col("id").cast("string").alias("CustomerID"), F.lit("a").alias("Segment"), (F.col("id") % 2).cast("int").alias("Churn"), (F.col("id") % 7).cast("double").alias(a))
    df = df.withColumn(b, F.when(tail, 2.0 * F.col("Churn") - 1).otherwise(0.0)).persist()
    for most in (learn.TASK_ROWS, 1000):
        models = learn.churn_models(df, rounds=2, depth=2, cv_rounds=1, folds=2, most=most).persist()
        assert models.first()["rows"] == 60_000 and models.first()["importance"][1] == 1.0
        got = learn.model_drivers(df, models).join(df.filter(tail).select("CustomerID"), "CustomerID")
        assert [r[0] for r in got.select(F.col("Drivers")[0]["feature"]).distinct().collect()] == [b]
    df.unpersist()


def test_quantiles_that_cut_bins_are_those_of_all_rows(spark):
    """Bin edges of fits in passes are exactly those that one task finds, ties, unknown and infinite values included."""
    rng = np.random.default_rng(11)
    x = np.column_stack((rng.normal(size=30_000), rng.integers(0, 5, 30_000), rng.choice([0.0, -0.0, np.nan, 1e300], 30_000), np.round(rng.exponential(size=30_000), 2)))
    x[:3, 0] = np.nan, np.inf, -np.inf
    g = np.where(np.arange(30_000) % 10 == 0, "small", "large")
    df = spark.createDataFrame([(str(a), b.tolist()) for a, b in zip(g, x)], "s string, x array<double>").repartition(5)
    got = forest.cut_points(df, "s", 4)
    for s in ("small", "large"):
        for a, b in zip(got[s], boosting.edges(x[g == s]), strict=True):
            assert len(a) == len(b) and np.allclose(a, b, rtol=1e-12)


def test_samples_of_large_segments_are_bounded_without_a_window(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("CustomerID"), F.when(F.col("id") % 20 == 0, "small").otherwise("large").alias("Segment"), F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("Churn"))
    got = learn._sampled(df, "Segment", "Churn", 3000)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    n = {r[0]: r[1] for r in got.groupBy("Segment").count().collect()}
    assert n["small"] == df.filter("Segment = 'small' and Churn is not null").count() and 2500 < n["large"] <= 3000


def test_ordered_targets_never_see_their_own_label(spark):
    df = spark.createDataFrame([(str(i), "ab"[i % 2] if i % 5 else None, None if i % 7 == 0 else int(i % 3 == 0)) for i in range(80)], "CustomerID string, c string, Churn int")
    rate = df.agg(F.avg("Churn")).first()[0]
    got = {r["CustomerID"]: r["c"] for r in learn.ordered_targets(df, ["c"], order=F.col("CustomerID").cast("int")).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["Churn"] is None, int(r["CustomerID"])))
    for k, r in enumerate(rows):
        before = [x["Churn"] for x in rows[:k] if x["c"] == r["c"] and x["Churn"] is not None]
        assert abs(got[r["CustomerID"]] - (sum(before) + rate) / (len(before) + 1)) < 1e-12
    assert learn.ordered_targets(df.limit(0), ["c"]).count() == 0


def test_batch_run_writes_every_stage(spark, tmp_path):
    out = str(tmp_path)
    got = batch.run(registry.QUERIES["customer_features"](spark, SF), out, seeds=3, rounds=20, uplift_rounds=20)
    n = registry.QUERIES["customer_features"](spark, SF).count()
    assert got.count() == n and {"segment", "churn_probability", "uplift_score", "umap_1", "gmm_prob_seg4", "net_roi"} <= set(got.columns)
    for stage in ("features", "segmented", "scored", "uplift", "customers"):
        assert load_stage(spark, f"{out}/{stage}").count() == n
    again = learn.segment_scores(load_stage(spark, f"{out}/segmented"), models=load_stage(spark, f"{out}/churn_models"))
    kept = load_stage(spark, f"{out}/scored").select("CustomerID", F.col("ChurnProbability").alias("p"))
    assert again.join(kept, "CustomerID").filter(F.col("p").eqNullSafe(F.col("ChurnProbability"))).count() == n


def kept_neighbours(x, y, n=10):
    """The mean share of each point's nearest neighbours that are nearest in the layout too."""
    near = lambda m: np.argsort(((m[:, None] - m) ** 2).sum(-1) + np.diag([np.inf] * len(m)), axis=1)[:, :n]
    a, b = near(x), near(y)
    return np.mean([len(set(p) & set(q)) / n for p, q in zip(a, b)])


def test_the_embedding_keeps_more_neighbours_than_the_projection(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, len(learn.CLUSTERING))) * 4
    m = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, len(learn.CLUSTERING)))
    df = spark.createDataFrame([(str(i), *v.tolist()) for i, v in enumerate(m)], "CustomerID string, " + ", ".join(f"{c} double" for c in learn.CLUSTERING)).repartition(3)
    z = (m - m.mean(0)) / m.std(0)

    def layout(out):
        got = {r[0]: r[1:] for r in out.select("CustomerID", "UMAP_1", "UMAP_2").collect()}
        assert len(got) == 600
        return np.array([got[str(i)] for i in range(600)])

    flat = kept_neighbours(z, layout(learn.pca_embedding(df)))
    near, placed = layout(learn.neighbour_embedding(df)), layout(learn.neighbour_embedding(df, landmarks=200))
    assert kept_neighbours(z, near) > flat + 0.1 and kept_neighbours(z, placed) > flat
    assert np.allclose(near, layout(learn.neighbour_embedding(df.repartition(5))))
    assert learn.neighbour_embedding(df.limit(0)).count() == 0 and learn.neighbour_embedding(df.limit(1)).count() == 1
    same = df.select("CustomerID", *[F.lit(1.0).alias(c) for c in learn.CLUSTERING])
    assert learn.neighbour_embedding(same).filter("isnan(UMAP_1) or UMAP_1 is null").count() == 0


def brute_silhouette(x, label):
    out = []
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        others = [d[i, label == c].mean() for c in set(label) if c != label[i]]
        out.append(0.0 if not own.any() or not others else (min(others) - d[i, own].mean()) / max(min(others), d[i, own].mean()))
    return np.array(out)


def test_silhouettes_are_those_of_brute_force(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(240, 4)) + 3 * rng.integers(0, 3, 240)[:, None]
    x = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], "CustomerID string, x array<double>").repartition(4)
    fits = [m[:3].copy(), m[10:15].copy(), np.vstack((m[:2], [[99.0] * 4])), m[:1].copy(), np.vstack((m[5:7], [[50.0] * 4]))]
    labels = [((m[:, None] - c) ** 2).sum(-1).argmin(1) for c in fits]
    whole = learn.silhouettes(x, fits)
    for got, label in zip(whole, labels):
        assert abs(got - brute_silhouette(m, label).mean()) < 1e-9
    order = [r[0] for r in x.orderBy(F.xxhash64("CustomerID", F.lit(5)), "x").select("CustomerID").limit(50).collect()]
    part = learn.silhouettes(x, fits, most=50)
    for got, label in zip(part, labels):
        assert abs(got - brute_silhouette(m, label)[[int(i) for i in order]].mean()) < 1e-9
    assert learn.silhouettes(x.limit(0), fits[:2]) == [0.0, 0.0]


def test_requests_are_scored_as_the_batch_scores_its_rows(spark, tmp_path):
    from tidemark.operators import features, serving

    out = str(tmp_path)
    rows = registry.QUERIES["customer_features"](spark, SF)
    batch.run(registry.bind.customer_features(spark, SF), out, seeds=2, rounds=8, uplift_rounds=4)
    kept = {n: load_stage(spark, f"{out}/{n}") for n in ("feature_stats", "codes", "segment_model", "churn_models", "uplift_models", "scored")}
    assert {r["learner"] for r in kept["uplift_models"].collect()} <= {"t0", "t1", "s"} and kept["segment_model"].count() == 5
    asked = registry.bind.customer_features(spark, SF).select("CustomerID", *features.CHURN_NUMERIC, "PreferredPaymentMode", "PreferedOrderCat")
    n = F.col("CustomerID").cast("long")
    asked = asked.withColumn("SatisfactionScore", F.when(n % 10 == 0, 9).otherwise(F.col("SatisfactionScore"))).withColumn("PreferredPaymentMode", F.when(n % 10 == 1, "unheard of").otherwise(F.col("PreferredPaymentMode")))
    got = {r["CustomerID"]: r for r in serving.score_by_models(asked, kept["feature_stats"], kept["segment_model"], kept["churn_models"], kept["codes"]).collect()}
    want = {r["CustomerID"]: r for r in kept["scored"].collect()}
    assert len(got) == rows.count() == len(want)
    for i, r in want.items():
        g = got[i]
        if int(i) % 10 == 0:
            assert not g["valid"] and g["segment"] is None and g["churn_probability"] is None and g["risk_tier"] is None
        else:
            assert g["valid"] and g["segment"] == r["Segment"]
            if int(i) % 10 != 1 and r["ChurnProbability"] is not None:
                assert abs(g["churn_probability"] - r["ChurnProbability"]) < 1e-4 and g["churn_prediction"] == (r["ChurnProbability"] >= 0.5)


def test_a_pass_adds_up_what_each_job_would_alone():
    rng = np.random.default_rng(5)
    m, h = rng.normal(size=(300, 4)), rng.integers(0, 1 << 62, 300).astype(np.uint64)
    centres, draws = [rng.normal(size=(k, 4)) for k in (3, 5, 3, 2, 5)], [None, 7, 7, None, 2]
    total = learn._step(centres, draws, 0.8)(m, h)
    assert len(total) == sum(c.size + len(c) + 1 for c in centres)
    for (new, cost), c, d in zip(learn._moved(total, centres), centres, draws):
        far = ((m[:, None] - c) ** 2).sum(-1)
        near, w = far.argmin(1), learn._times(h, d, 0.8)
        want = [np.average(m[near == i], axis=0, weights=w[near == i]) if w[near == i].sum() else c[i] for i in range(len(c))]
        assert np.allclose(new, want) and np.isclose(cost, far.min(1) @ w)


def test_no_segment_is_sent_to_one_task_for_its_statistics(spark):
    from tidemark.operators import scoring

    df = spark.range(40).select(F.col("id").cast("string").alias("CustomerID"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("Segment"), F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("Churn"))
    imp = spark.createDataFrame([("s0", "a", 1.0), ("s1", "a", 1.0)], "Segment string, feature string, importance double")
    for out in (scoring.drivers_by_segment(df, imp, ["a"], 1), learn._sampled(df, "Segment", "Churn", 10)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
