"""Learned stages: clusters with all restarts in one pass, soft memberships, a projection, per-segment churn models and uplift learners."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tidemark.functions.semantics import is_true, risk_tier
from tidemark.operators import boosting, forest, metrics
from tidemark.operators.features import CATEGORIES, CHURN_NUMERIC, CLUSTERING, COMPOSITES, UPLIFT, one_row_join, score_columns
from tidemark.operators.ranks import running
from tidemark.sources.stage import written

#: Rows from which starting centres are drawn.
START_ROWS = 2048
#: Labelled rows that an uplift learner is fitted on; the rest is only scored.
FIT_ROWS = 50_000
#: Labelled rows of a segment up to which one task fits its churn model, on all of them; from larger segments on, all tasks fit all segments together.
TASK_ROWS = 1_000_000
#: All features of the churn models; a table without some of the categories is fitted without them.
CHURN_FEATURES = [*CHURN_NUMERIC, *CATEGORIES, *COMPOSITES]


def scale_stats(df: DataFrame, columns: list[str] = CLUSTERING) -> DataFrame:
    """The one row of means and population deviations that z-scores need."""
    rows = df.select(*score_columns(df, columns))
    return rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])


def scaled(df: DataFrame, columns: list[str] = CLUSTERING, key: str = "CustomerID", stats: DataFrame | None = None) -> DataFrame:
    """(key, x): z-scores by the population deviation (1 where it is 0) of all rows, or by the given one-row statistics, as an array; kept while a fit passes over it again and again. Unpersist it afterwards."""
    rows = df.select(key, *score_columns(df, columns))
    z = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), F.lit(0.0)) for c in columns]
    return one_row_join(rows, scale_stats(df, columns) if stats is None else stats).select(key, F.array(*z).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def _times(ids: np.ndarray, draw: int | None, share: float) -> np.ndarray:
    """How often a resample with replacement holds each row: Poisson of mean ``share``, by a hash of the row and the resample. None: once each."""
    return np.ones(len(ids)) if draw is None else _all_times(ids, [draw], share)[:, 0]


def _all_times(ids: np.ndarray, draws: list[int], share: float) -> np.ndarray:
    """``_times`` of several resamples, a column each."""
    h = (ids[:, None] ^ np.array([d * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for d in draws], np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)) / float(1 << 53)
    steps = np.cumsum([np.exp(-share) * share**i / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(12)])
    return np.searchsorted(steps, u).astype(float)


def blocks(x: DataFrame, block: int = 1024) -> DataFrame:
    """(x, id, width): ``block`` rows' matrix and hashes as bytes, kept for fits of hundreds of passes, which then only copy them. Unpersist it afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), block):
                batch = whole.slice(i, block)
                m = _matrix(batch)
                values = m.astype("<f8").tobytes(), batch.column("id").to_numpy().astype("<i8").tobytes(), m.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.binary(), pa.binary(), pa.int32()))], ["x", "id", "width"])

    return x.select("x", F.xxhash64(x.columns[0]).alias("id")).mapInArrow(run, "x binary, id binary, width int").persist(StorageLevel.MEMORY_AND_DISK)


def _total(x: DataFrame, part, block: int = 1024, few: bool = False) -> np.ndarray:
    """The sum of ``part(matrix, row hashes)``, an array of fixed size, over all batches of at most ``block`` rows: added up in each task, then, unless tasks are ``few``, in 32 groups, then here.

    ``x`` holds rows, or blocks of them (``blocks``).
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for whole in batches:
            if "width" in whole.schema.names:
                for rows, ids, width in zip(whole.column("x"), whole.column("id"), whole.column("width")):
                    yield part(np.frombuffer(rows.as_buffer(), "<f8").reshape(-1, width.as_py()), np.frombuffer(ids.as_buffer(), "<u8"))
                continue
            for i in range(0, len(whole), block):
                batch = whole.slice(i, block)
                yield part(_matrix(batch), batch.column("id").to_numpy().view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for got in parts(batches):
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()])], ["total"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"total": [sum(np.frombuffer(b, "<f8") for b in p["total"]).tobytes()]})

    rows = x if "width" in x.columns else x.select("x", F.xxhash64(x.columns[0]).alias("id"))
    sums = rows.mapInArrow(run, "total binary")
    if not few:
        sums = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(32))).applyInPandas(add, "total binary")
    return sum(np.frombuffer(r[0], "<f8") for r in sums.collect())  # at most 32 rows, or one for each of few tasks


def _step(centres: list[np.ndarray], draws: list[int | None], share: float):
    """What a pass adds up for each job: of each of its clusters the sums and number of rows, and the cost. Jobs of one number of clusters are computed together, as (rows, clusters, jobs)."""
    jobs_of: dict[int, list[int]] = {}
    for j, c in enumerate(centres):
        jobs_of.setdefault(len(c), []).append(j)
    known = sorted({d for d in draws if d is not None})
    place = {d: i for i, d in enumerate([*known, None])}
    groups = []
    for k, js in jobs_of.items():
        c = np.stack([centres[j] for j in js], axis=1).reshape(k * len(js), -1)
        groups.append((k, js, np.column_stack((-2 * c, (c * c).sum(1))).T, np.array([place[draws[j]] for j in js])))

    def part(m: np.ndarray, h: np.ndarray) -> np.ndarray:
        times = np.column_stack((_all_times(h, known, share), np.ones(len(m)))) if known else None
        one, own = np.column_stack((m, np.ones(len(m)))), (m * m).sum(1)[:, None]
        out: list = [None] * len(centres)
        for k, js, c, of in groups:
            far = (one @ c).reshape(len(m), k, len(js))  # less the row's own square
            best = far.min(axis=1)
            w = 1.0 if times is None else times[:, of]
            free = np.ones(best.shape, bool)
            for i in range(k):  # of equally near centres the first
                hit = (far[:, i] == best) & free
                free ^= hit
                np.multiply(hit, w, out=far[:, i])
            sums = (one.T @ far.reshape(len(m), -1)).reshape(-1, k, len(js))
            cost = (np.maximum(0, best + own) * w).sum(0)
            for at, j in enumerate(js):
                out[j] = np.concatenate((sums[:-1, :, at].T.ravel(), sums[-1, :, at], cost[at : at + 1]))
        return np.concatenate(out)

    return part


def _moved(total: np.ndarray, centres: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """(new centres, cost of the old ones) of each job from what a pass added up; a cluster without rows keeps its centre."""
    out, at = [], 0
    for c in centres:
        k, width = c.shape
        sums, n = total[at : at + k * width].reshape(k, width), total[at + k * width : at + k * width + k]
        out.append((np.where(n[:, None] > 0, sums / np.maximum(n, 1e-12)[:, None], c), total[at + k * width + k]))
        at += k * width + k + 1
    return out


def lloyd(x: DataFrame, jobs: list[tuple[int, int, int | None]], iterations: int = 300, share: float = 0.8, tolerance: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of each job (k, seed, resample): K-means with all jobs advancing in the same pass over the rows.

    A pass reads every row once for all restarts and resamples that haven't converged, so 500 fits cost as many passes as the slowest of them. Starting centres are drawn by
    K-means++ from ``START_ROWS`` rows, the first by a hash; every other step takes all rows. A cluster that loses all rows keeps its centre.
    """
    pick = x.select("x", F.xxhash64(x.columns[0]).alias("id")).orderBy(F.xxhash64(x.columns[0], F.lit(1)), "x").limit(START_ROWS).toPandas()
    some, ids = np.array(pick["x"].tolist()), pick["id"].to_numpy().view(np.uint64)
    centres = []
    for k, seed, draw in jobs:
        rng, own = np.random.default_rng([seed, k]), some[_times(ids, draw, share) > 0]
        own = own if len(own) else some
        c = own[rng.integers(len(own))][None]
        while len(c) < k:
            d = ((own[:, None] - c) ** 2).sum(-1).min(1)
            c = np.vstack((c, own[rng.choice(len(own), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(own))]))
        centres.append(c)
    costs = np.zeros(len(jobs))
    # Blocks of rows are such that a task holds about 2 MB for each array of (rows, clusters, jobs).
    block = lambda active: max(64, min(1024, (1 << 18) // sum(len(centres[j]) for j in active)))

    active = list(range(len(jobs)))
    for _ in range(iterations):
        if not active:
            break
        now = [centres[j] for j in active]
        total, left = _total(x, _step(now, [jobs[j][2] for j in active], share), block(active)), []
        for j, c, (new, cost) in zip(active, now, _moved(total, now)):
            centres[j], costs[j] = new, cost
            if ((new - c) ** 2).sum() > tolerance:
                left.append(j)
        active = left
    return list(zip(centres, costs))


def best_kmeans(x: DataFrame, k: int = 5, seeds: int = 20, iterations: int = 500, seed: int = 42) -> np.ndarray:
    """The centres of least cost over several starts."""
    return min(lloyd(x, [(k, seed + i, None) for i in range(seeds)], iterations), key=lambda m: m[1])[0]


def assigned(x: DataFrame, centres: np.ndarray) -> DataFrame:
    """``x`` with ``prediction``, the nearest centre."""
    d = [F.aggregate(F.zip_with("x", F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    return x.withColumn("prediction", F.array_min(F.array(*[F.struct(v.alias("d"), F.lit(i).alias("i")) for i, v in enumerate(d)]))["i"])


def segment_model(df: DataFrame, k: int = 5, seeds: int = 20, iterations: int = 500) -> DataFrame:
    """(RawSegment, Segment, centre, stats): the clusters with their labels by ranked profiles and their centres among z-scores, and the statistics that these take, as JSON. One row for each cluster that has rows."""
    from tidemark.operators.scoring import rank_labels

    stats = written(scale_stats(df))
    x = scaled(df, stats=stats)
    centres = best_kmeans(x, k, seeds, iterations)
    got = assigned(x, centres).select("CustomerID", F.col("prediction").alias("RawSegment"))
    names = {r["RawSegment"]: r["label"] for r in rank_labels(df.join(got, "CustomerID")).collect()}  # one row for each cluster
    x.unpersist()
    saved = json.dumps(stats.first().asDict())
    return df.sparkSession.createDataFrame([(i, names[i], [float(v) for v in c], saved) for i, c in enumerate(centres) if i in names], "RawSegment int, Segment string, centre array<double>, stats string")


def segments_of(df: DataFrame, model: DataFrame) -> DataFrame:
    """(CustomerID, RawSegment, Segment) of every row by a kept ``segment_model``."""
    rows = model.orderBy("RawSegment").collect()  # one for each cluster
    stats = json.loads(rows[0]["stats"])
    one = df.sparkSession.createDataFrame([tuple(stats.values())], ", ".join(f"`{c}` double" for c in stats))
    x = scaled(df, stats=one)
    near = assigned(x, np.array([r["centre"] for r in rows]))
    x.unpersist()
    each = F.element_at(F.lit([r["RawSegment"] for r in rows]), F.col("prediction") + 1), F.element_at(F.lit([r["Segment"] for r in rows]), F.col("prediction") + 1)
    return near.select("CustomerID", each[0].alias("RawSegment"), each[1].alias("Segment"))


def kmeans_segments(df: DataFrame, k: int = 5, seeds: int = 20, iterations: int = 500) -> DataFrame:
    """(CustomerID, RawSegment, Segment): clusters, labelled by their ranked profiles."""
    return segments_of(df, segment_model(df, k, seeds, iterations))


#: Added to every component's weighted density, so a row far from all components belongs to all alike.
EPSILON = 2.0**-52
#: Rows that each component of a mixture starts from.
START_EACH = 5

#: Tasks of a pass whose sums (some KB each) are added up on the driver.
FEW_TASKS = 256

#: A mixture: weights, means and covariances of its components.
Mixture = tuple[np.ndarray, np.ndarray, np.ndarray]


def _densities(mixtures: list[Mixture]):
    """The function that gives (rows, mixtures, components) weighted densities, plus ``EPSILON``, of (width + 1, rows) values that end with ones. A singular covariance's density is that by its pseudo-inverse."""
    weights, means, covariances = (np.concatenate(v) for v in zip(*mixtures))
    parts, width = means.shape
    values, vectors = np.linalg.eigh(covariances)
    kept = values > EPSILON * width * np.maximum(values.max(axis=1, keepdims=True), 0)
    values = np.where(kept, values, 1.0)
    roots = vectors * (kept / np.sqrt(values))[:, None]
    # Of all components in one product: (x - mean) times the root of the inverse.
    whiten = np.concatenate((roots, -np.einsum("pi,pij->pj", means, roots)[:, None]), axis=1).transpose(1, 2, 0).reshape(width + 1, -1)
    logs = np.log(weights) - 0.5 * (width * np.log(2 * np.pi) + np.log(values).sum(axis=1))

    def of(t: np.ndarray) -> np.ndarray:
        z = (t.T @ whiten).reshape(-1, width, parts)
        p = np.einsum("nwp,nwp->np", z, z)
        p *= -0.5
        p += logs
        np.exp(p, out=p)
        p += EPSILON
        return p.reshape(len(p), len(mixtures), -1)

    return of


def _expectation(mixtures: list[Mixture]):
    """What a pass adds up for all mixtures: of each component the memberships' products with all pairs of a row's values and 1, and of each mixture the log-likelihood."""
    of = _densities(mixtures)
    a, b = np.triu_indices(mixtures[0][1].shape[1] + 1)

    def part(m: np.ndarray, _: np.ndarray) -> np.ndarray:
        t = np.vstack((m.T, np.ones(len(m))))
        p = of(t)
        total = sum(p[:, :, i] for i in range(p.shape[2]))
        p /= total[:, :, None]
        return np.concatenate(((p.reshape(len(m), -1).T @ (t[a] * t[b]).T).ravel(), np.log(total).sum(axis=0)))

    return part


def _maximised(total: np.ndarray, k: int, width: int) -> list[tuple[Mixture, float]]:
    """(new mixture, log-likelihood of the old one) of each fit from what a pass added up."""
    a, b = np.triu_indices(width + 1)
    fits = len(total) // (k * len(a) + 1)
    sums = np.empty((fits, k, width + 1, width + 1))
    sums[:, :, a, b] = sums[:, :, b, a] = total[:-fits].reshape(fits, k, -1)
    out = []
    for s, likelihood in zip(sums, total[-fits:]):
        n = s[:, -1, -1]
        means = s[:, -1, :-1] / n[:, None]
        out.append(((n / n.sum(), means, s[:, :-1, :-1] / n[:, None, None] - means[:, :, None] * means[:, None]), float(likelihood)))
    return out


def mixtures(x: DataFrame, k: int, seeds: list[int], iterations: int = 200, tolerance: float = 0.01) -> list[tuple[Mixture, float]]:
    """(mixture, log-likelihood before its last step) of Gaussians with full covariances for each seed, by expectation and maximisation; all seeds advance in the same pass over the rows.

    A fit ends when its log-likelihood moves by no more than ``tolerance`` in all. Every component starts from the mean and the variances of ``START_EACH`` rows, drawn from ``START_ROWS`` rows by a hash; every step
    takes all rows. No rows: no mixtures.
    """
    some = np.array(x.orderBy(F.xxhash64(x.columns[0], F.lit(7)), "x").limit(START_ROWS).select("x").toPandas()["x"].tolist())
    if not len(some):
        return []
    fits: list[tuple[Mixture, float]] = []
    for seed in seeds:
        own = some[np.random.default_rng([seed, k]).integers(len(some), size=(k, START_EACH))]
        fits.append(((np.full(k, 1 / k), own.mean(axis=1), np.eye(some.shape[1]) * own.var(axis=1)[:, None]), -np.inf))
    rows = blocks(x)
    few = rows.select(F.spark_partition_id()).distinct().count() <= FEW_TASKS
    active = list(range(len(seeds)))
    for _ in range(iterations):
        if not active:
            break
        got = _maximised(_total(rows, _expectation([fits[j][0] for j in active]), few=few), k, some.shape[1])
        left = [j for j, (_, likelihood) in zip(active, got) if abs(likelihood - fits[j][1]) > tolerance]
        for j, fit in zip(active, got):
            fits[j] = fit
        active = left
    rows.unpersist()
    return fits


def gmm_soft(df: DataFrame, k: int = 5, seeds: int = 5, iterations: int = 200) -> DataFrame:
    """(CustomerID, GMM_Segment, GMM_Prob_Seg0..): the likeliest component and soft memberships of the mixture of greatest likelihood over several seeds. No rows: no rows."""
    x = scaled(df, stats=written(scale_stats(df)))
    x.unpersist()  # read twice only: for the starts and for the blocks
    fits = mixtures(x, k, [42 + i for i in range(seeds)], iterations)
    of = _densities([max(fits, key=lambda f: f[1])[0]]) if fits else None
    names = [f"GMM_Prob_Seg{i}" for i in range(k)]
    schema = T.StructType([x.schema["CustomerID"], T.StructField("GMM_Segment", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                p = of(np.vstack((_matrix(batch).T, np.ones(len(batch)))))[:, 0]
                p /= p.sum(axis=1)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("CustomerID"), pa.array(p.argmax(axis=1), pa.int32()), *map(pa.array, p.T)], schema.names)

    return x.mapInArrow(place, schema)


def pca_embedding(df: DataFrame) -> DataFrame:
    """(CustomerID, UMAP_1, UMAP_2): a linear projection under the reference's column names."""
    rows = scaled(df)
    x, a = rows.select("CustomerID", array_to_vector("x").alias("features")), vector_to_array("p")
    model = PCA(k=2, inputCol="features", outputCol="p").fit(x)
    rows.unpersist()
    return model.transform(x).select("CustomerID", a[0].alias("UMAP_1"), a[1].alias("UMAP_2"))


#: Rows that the embedding is fitted on, and that silhouettes are computed for.
LANDMARKS, SILHOUETTES = 1500, 2000


def _landmark_layout(x: np.ndarray, near: int = 10, rounds: int = 450, seed: int = 42) -> np.ndarray:
    """Two coordinates of each landmark, by gradient steps on pairs of near, middle and far points.

    Near pairs are each point's nearest neighbours; a middle pair is the second nearest of six points drawn; far pairs are drawn among the rest. With d = 1 + squared distance in the layout the loss is
    d / (10 + d) for near, d / (10000 + d) for middle and 1 / (1 + d) for far pairs; middle pairs weigh much at first, which sets the global shape, and nothing at last, when near pairs settle.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    y = centred @ axes[:2].T if len(axes) > 1 else np.column_stack((centred @ axes[0], np.zeros(n)))
    y = 0.01 * y / max(1e-12, np.abs(y).max()) + 1e-6 * rng.normal(size=y.shape)
    near = min(near, n - 1)
    if near < 1:
        return y
    far = (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)
    np.fill_diagonal(far, np.inf)
    own = np.repeat(np.arange(n), near)
    close = np.argpartition(far, near - 1, axis=1)[:, :near].ravel()
    each = max(1, near // 2)
    drawn = rng.integers(0, n, (n, each, 6))
    middle = np.take_along_axis(drawn, np.argsort(far[np.arange(n)[:, None, None], drawn], axis=2)[:, :, 1:2], 2).ravel()
    away = rng.integers(0, n, n * near * 2)
    sides = [(own, close), (np.repeat(np.arange(n), each), middle), (np.repeat(np.arange(n), near * 2), away)]
    m, v = np.zeros_like(y), np.zeros_like(y)
    for t in range(rounds):
        w_near, w_middle = (2.0, 1000 * (1 - t / 100) + 3 * t / 100) if t < 100 else (3.0, 3.0) if t < 200 else (1.0, 0.0)
        grad = np.zeros_like(y)
        for (a, b), weight, c in zip(sides, (w_near, w_middle, 1.0), (10.0, 10000.0, None)):
            if weight:
                gap = y[a] - y[b]
                d = 1 + (gap * gap).sum(1)
                slope = weight * 2 * (c / (c + d) ** 2 if c else -1 / (1 + d) ** 2)
                push = slope[:, None] * gap
                for k in range(2):
                    grad[:, k] += np.bincount(a, push[:, k], n) - np.bincount(b, push[:, k], n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        y = y - (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-7)
    return y


def neighbour_embedding(df: DataFrame, landmarks: int = LANDMARKS, near: int = 10, weigh: int = 5) -> DataFrame:
    """(CustomerID, UMAP_1, UMAP_2): two coordinates that keep neighbours together, under the names that dashboards expect.

    At most ``landmarks`` rows, by a hash of the id, are laid out on the driver (``_landmark_layout``); every other row is placed among its ``weigh`` nearest landmarks, by inverse squared distance, in tasks that each hold
    the landmarks. No rows: no rows.
    """
    rows = scaled(df)
    pick = rows.orderBy(F.xxhash64("CustomerID", F.lit(3)), "CustomerID").limit(landmarks).select("x").toPandas()
    if pick.empty:
        rows.unpersist()
        return df.select("CustomerID", F.lit(0.0).alias("UMAP_1"), F.lit(0.0).alias("UMAP_2"))
    at = np.unique(np.array(pick["x"].tolist()), axis=0)
    y = _landmark_layout(at, near)
    weigh = min(weigh, len(at))
    schema = T.StructType([rows.schema["CustomerID"], T.StructField("UMAP_1", T.DoubleType()), T.StructField("UMAP_2", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                m = _matrix(batch)
                far = np.maximum(0, (m * m).sum(1)[:, None] - 2 * m @ at.T + (at * at).sum(1))
                nearest = np.argpartition(far, weigh - 1, axis=1)[:, :weigh]
                d = np.take_along_axis(far, nearest, 1)
                w = 1 / (d + 1e-9)
                got = (w[:, :, None] * y[nearest]).sum(1) / w.sum(1)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("CustomerID"), pa.array(got[:, 0]), pa.array(got[:, 1])], schema.names)

    out = written(rows.mapInArrow(place, schema))
    rows.unpersist()
    return out


def silhouettes(x: DataFrame, fits: list[np.ndarray], most: int = SILHOUETTES) -> list[float]:
    """The mean silhouette of each clustering (its centres), by Euclidean distance: of at most ``most`` rows, by a hash, each compared with all rows, in one pass for all clusterings. 0 for a row alone in its cluster, and
    with fewer than two clusters."""
    pick = x.orderBy(F.xxhash64(x.columns[0], F.lit(5)), "x").limit(most).select("x").toPandas()
    if pick.empty:
        return [0.0] * len(fits)
    some = np.array(pick["x"].tolist())
    nearest = lambda m, c: ((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)).argmin(1)

    def part(m: np.ndarray, _: np.ndarray) -> np.ndarray:
        d = m @ (-2 * some.T)
        d += (m * m).sum(1)[:, None] + (some * some).sum(1)
        d = np.sqrt(np.maximum(d, 0, out=d), out=d)
        out = []
        for c in fits:
            z = np.eye(len(c))[nearest(m, c)]
            out += [(z.T @ d).ravel(), z.sum(0)]
        return np.concatenate(out)

    total, at, means = _total(x, part, 256), 0, []
    for c in fits:
        k = len(c)
        sums, n = total[at : at + k * len(some)].reshape(k, -1), total[at + k * len(some) : at + k * len(some) + k]
        at += k * len(some) + k
        own = nearest(some, c)
        cells = np.arange(len(some))
        a = sums[own, cells] / np.maximum(n[own] - 1, 1)
        other = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], np.inf)
        other[own, cells] = np.inf
        b = other.min(0)
        ok = (n[own] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
        means.append(float(np.where(ok, (b - a) / np.where(ok, np.maximum(a, b), 1), 0.0).mean()))
    return means


def k_sweep(df: DataFrame, ks: range = range(2, 9), seeds: int = 10, iterations: int = 300) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin) for each number of clusters; all fits advance together."""
    x = scaled(df)
    jobs = [(k, 42 + i, None) for k in ks for i in range(seeds)]
    fits, rows = lloyd(x, jobs, iterations), []
    best = [min((f for f, j in zip(fits, jobs) if j[0] == k), key=lambda m: m[1]) for k in ks]
    sharp = silhouettes(x, [c for c, _ in best])
    for k, (centres, cost), silhouette in zip(ks, best, sharp):
        got = assigned(x, centres)
        near = metrics.davies_bouldin(got.select("prediction", *[F.col("x")[i].alias(c) for i, c in enumerate(CLUSTERING)]), "prediction", CLUSTERING).first()[0]
        rows.append((k, float(cost), silhouette, near))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double")


def bootstrap_agreement(df: DataFrame, n: int = 100, k: int = 5, share: float = 0.8, seeds: int = 5, iterations: int = 300) -> DataFrame:
    """(resample, ari): the agreement between a fit on all rows and the fit on each of ``n`` resamples with replacement, each the best of several seeds, over all rows."""
    x = scaled(df)
    jobs = [(k, i * seeds + s, i) for i in range(n) for s in range(seeds)] + [(k, 42 + i, None) for i in range(10)]
    fits = lloyd(x, jobs, iterations, share)
    best = [min((f for f, j in zip(fits, jobs) if j[2] == i), key=lambda m: m[1])[0] for i in [*range(n), None]]

    def part(m: np.ndarray, _: np.ndarray) -> np.ndarray:
        near = [((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)).argmin(1) for c in best]
        return np.concatenate([np.bincount(near[-1] * k + a, minlength=k * k) for a in near[:-1]])

    cells = _total(x, part).reshape(n, k, k)
    x.unpersist()
    two = lambda v: (v * (v - 1) / 2).sum()
    rows = []
    for i, c in enumerate(cells):
        both, a, b, pairs = two(c), two(c.sum(1)), two(c.sum(0)), two(c.sum())
        expected = a * b / pairs if pairs else 0.0
        most = (a + b) / 2 - expected
        rows.append((i, float((both - expected) / most) if most else 1.0))
    return df.sparkSession.createDataFrame(rows, "resample int, ari double")


def bootstrap_stability(df: DataFrame, n: int = 100, k: int = 5, share: float = 0.8, seeds: int = 5) -> DataFrame:
    """(mean, std, min, max, grade) of ``bootstrap_agreement``."""
    got = bootstrap_agreement(df, n, k, share, seeds)
    out = got.agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("std"), F.min("ari").alias("min"), F.max("ari").alias("max"))
    return out.withColumn("grade", F.when(F.col("mean") >= 0.85, "Highly Stable").when(F.col("mean") >= 0.70, "Moderately Stable").otherwise("Unstable"))


def _features(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *score_columns(df, columns)).select(*keep, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("x"))


def _nothing(*names: str) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def _sampled(df: DataFrame, group: str, label: str, most: int) -> DataFrame:
    """About ``most`` labelled rows of each group at most, by a hash of the id below the group's threshold, with the hash as ``draw``. No group is sorted or gathered for it."""
    known = df.filter(F.col(label).isNotNull()).withColumn("draw", F.xxhash64("CustomerID", F.lit(42)))
    share = (most - 4 * most**0.5) / F.col("n")
    sizes = known.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("n")).select("of", F.when(F.col("n") > most, share).otherwise(1.0).alias("share"))  # one row for each group
    unit = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    return known.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("of"))).filter(unit < F.col("share")).drop("of", "share")


def churn_features(df: DataFrame) -> list[str]:
    """The churn models' features that a table has: 26, or 23 where three categories are unknown."""
    return [c for c in CHURN_FEATURES if c in df.columns]


def ordered_targets(df: DataFrame, columns: list[str], label: str = "Churn", key: str = "CustomerID", prior: float = 1.0, order: Column | None = None) -> DataFrame:
    """``df`` with categories replaced by ordered target statistics: (positives before + prior * overall rate) / (labelled rows before + prior), over the labelled rows of the category before a row in a fixed order.

    The order is a hash of the key unless another is given, so a row's own label never enters its code. Rows without a label come last and so see all labels. Categories of any share are summed up by ranges. Nulls are a category.
    """
    rate = df.agg(F.avg(F.col(label).cast("double")).alias("target_rate"))
    out = one_row_join(df, rate).withColumn("target_rate", F.coalesce("target_rate", F.lit(0.0)))
    known = F.col(label).isNotNull()
    places = [F.when(known, 0).otherwise(1), F.xxhash64(key, F.lit(7)) if order is None else order, F.col(key)]
    for c in columns:
        out = running(out, [F.col(c)], places, {"_hits": F.col(label).cast("double"), "_seen": known.cast("double")})
        out = out.withColumn(c, (F.col("_hits") + prior * F.col("target_rate")) / (F.col("_seen") + prior)).drop("_hits", "_seen")
    return out.drop("target_rate")


FIGURES = [f"{a}_{b}" for a in ("train", "holdout") for b in ("auc", "ap", "brier")]
MODEL = "Segment string, rows long, features array<string>, model binary, importance array<double>, cv_auc double, cv_ap double, " + ", ".join(f"{n} double" for n in FIGURES)
ARROW_MODEL = pa.schema({"Segment": pa.string(), "rows": pa.int64(), "features": pa.list_(pa.string()), "model": pa.binary(), "importance": pa.list_(pa.float64()), **{n: pa.float64() for n in ("cv_auc", "cv_ap", *FIGURES)}})


def churn_models(df: DataFrame, rounds: int = 500, depth: int = 6, cv_rounds: int = 100, folds: int = 3, most: int | None = TASK_ROWS) -> DataFrame:
    """(Segment, rows, features, model, importance, cv_auc, cv_ap, train_*, holdout_*): one row for each segment of at least 50 labelled rows with both classes, fitted on all of them.

    80 % of each class are for training and the rest for the holdout, both by a hash of the id; ``folds`` stratified folds of the training rows with ``cv_rounds`` rounds give cv_auc and cv_ap. Positives weigh as
    much as negatives do. Importances are gains over the largest gain, in the order of ``features``.

    ``most``: while no segment has more labelled rows, each segment's model is fitted in one task. Otherwise, and for None, all segments are fitted together, in passes that no segment dominates (``forest``), one
    for each level of each tree. Both take every labelled row and give the same trees, but for the folds' bins: those of the fold's own rows in one task, those of the segment's whole training part in passes.
    """
    names = churn_features(df)
    rows = _features(df, names, "CustomerID", "Segment", "Churn").filter(F.col("Churn").isNotNull())
    if most is None or (rows.groupBy("Segment").count().agg(F.max("count")).first()[0] or 0) > most:
        return _churn_models_of_all(rows, names, rounds, depth, cv_rounds, folds)

    def train(t: pa.Table) -> pa.Table:
        order = t.select(["draw", "CustomerID"]).to_pandas().sort_values(["draw", "CustomerID"]).index.to_numpy()
        x, y = _matrix(t.select(["x"]).combine_chunks().to_batches()[0])[order], t.column("Churn").to_numpy().astype(float)[order]
        if len(y) < 50 or len(set(y)) < 2:
            return ARROW_MODEL.empty_table()
        nth = np.empty(len(y), np.int64)  # of its class
        for c in (0.0, 1.0):
            nth[y == c] = np.arange((y == c).sum())
        is_train = nth < np.round(0.8 * np.where(y == 1, y.sum(), len(y) - y.sum()))
        weight = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)

        def fitted(use: np.ndarray, n: int) -> dict | None:
            return boosting.fit(x[use], y[use], weight[use], n, depth) if len(set(y[use])) == 2 else None

        cv = []
        for f in range(folds):
            out = is_train & (nth % folds == f)
            m = fitted(is_train & ~out, cv_rounds)
            if m and len(set(y[out])) == 2:
                cv.append(boosting.quality(y[out], boosting.predict(m, x[out]))[:2])
        model = fitted(is_train, rounds)
        if model is None:
            return ARROW_MODEL.empty_table()
        scores = boosting.predict(model, x)
        got = [*boosting.quality(y[is_train], scores[is_train]), *boosting.quality(y[~is_train], scores[~is_train])]
        auc, ap = np.mean(cv, axis=0).tolist() if cv else (0.5, 0.0)
        return pa.Table.from_pylist([dict(zip(ARROW_MODEL.names, (t.column("Segment")[0].as_py(), len(y), names, pickle.dumps(model), _shares(model), auc, ap, *got)))], ARROW_MODEL)

    return rows.withColumn("draw", F.xxhash64("CustomerID", F.lit(42))).groupBy("Segment").applyInArrow(train, MODEL)


def _shares(model: dict) -> list[float]:
    """Gains over the largest gain."""
    return (model["gain"] / max(model["gain"].max(), 1e-300)).tolist()


def _churn_models_of_all(rows: DataFrame, names: list[str], rounds: int, depth: int, cv_rounds: int, folds: int) -> DataFrame:
    """``churn_models`` on all labelled rows. What comes to the driver is one model for each segment and fold, and their figures."""
    known = rows.filter(F.col("Churn").isNotNull() & F.col("Segment").isNotNull())
    placed = running(known, [F.col("Segment"), F.col("Churn")], [F.xxhash64("CustomerID", F.lit(42)), F.col("CustomerID")], {"nth": F.lit(1)}, {"of_class": F.lit(1)})
    sizes = known.groupBy(F.col("Segment").alias("of")).agg(F.count_if(F.col("Churn") == 1).alias("pos"), F.count_if(F.col("Churn") == 0).alias("neg")).filter("pos + neg >= 50 and pos > 0 and neg > 0")
    weight = F.when(F.col("Churn") == 1, F.greatest(F.lit(1.0), F.col("neg") / F.col("pos"))).otherwise(1.0)
    used = placed.join(sizes, F.col("Segment") == F.col("of")).withColumns({"weight": weight, "is_train": F.col("nth") < F.round(0.8 * F.col("of_class")), "fold": (F.col("nth") % folds).cast("int"), "rows": F.col("pos") + F.col("neg")})
    used = written(used.select("CustomerID", "Segment", "Churn", "x", "weight", "is_train", "fold", "rows"))
    models = forest.fit_all(used.filter("is_train"), "Segment", "Churn", rounds, depth, folds, cv_rounds)
    spark = rows.sparkSession
    main = {g: m for (g, out), m in models.items() if out is None}
    if not main:
        return spark.createDataFrame([], MODEL)
    scored = written(_applied(used, {(g, "p" if out is None else f"p{out}"): (m, None) for (g, out), m in models.items()}, "Segment", ["p", *[f"p{k}" for k in range(folds)]]))
    part = metrics.auc_ap_brier(scored, "p", "Churn", by=("Segment", "is_train")).collect()  # two rows for each segment
    own = F.coalesce(*[F.when(F.col("fold") == k, F.col(f"p{k}")) for k in range(folds)])
    both = scored.filter("is_train").withColumn("own", own).groupBy("Segment", "fold").agg(F.count_distinct("Churn").alias("classes")).filter("classes = 2").select(F.col("Segment").alias("s2"), F.col("fold").alias("f2"))
    left_out = scored.filter("is_train").withColumn("own", own).join(both, (F.col("Segment") == F.col("s2")) & (F.col("fold") == F.col("f2")), "left_semi")
    cv: dict[str, list] = {}
    for r in metrics.auc_ap_brier(left_out, "own", "Churn", by=("Segment", "fold")).collect():
        cv.setdefault(r["Segment"], []).append((r["auc"], r["ap"]))
    figures = {(r["Segment"], r["is_train"]): (r["auc"], r["ap"], r["brier"]) for r in part}
    n = {r[0]: r[1] for r in used.groupBy("Segment").agg(F.max("rows")).collect()}
    none = (0.5, 0.0, None)
    rows_ = [(g, n[g], names, bytearray(pickle.dumps(m)), _shares(m), *(float(v) for v in (np.mean(cv[g], axis=0) if g in cv else (0.5, 0.0))), *figures.get((g, True), none), *figures.get((g, False), none)) for g, m in main.items()]
    return spark.createDataFrame(rows_, MODEL)


def segment_importance(models: DataFrame) -> DataFrame:
    """(Segment, feature, importance, rank): importances of each segment's model, largest first."""
    each = models.select("Segment", "features", F.posexplode("importance").alias("pos", "importance"))
    return each.select("Segment", F.get("features", F.col("pos")).alias("feature"), "importance", F.row_number().over(Window.partitionBy("Segment").orderBy(F.desc("importance"), "pos")).alias("rank"))


def top_importances(models: DataFrame, segment: str, n: int = 15) -> DataFrame:
    return segment_importance(models).filter((F.col("Segment") == segment) & (F.col("rank") <= n)).orderBy("rank")


def run_metrics(models: DataFrame) -> DataFrame:
    """(Segment, rows, metric, value): the figures of each segment's model, long."""
    return models.unpivot(["Segment", "rows"], ["cv_auc", "cv_ap", *FIGURES], "metric", "value")


def _applied(rows: DataFrame, models: dict, group: str | None, names: list[str]) -> DataFrame:
    """``rows`` without ``x``, with one probability a name: models[(group value, name)] of the row, null where there is none."""
    keep = [c for c in rows.columns if c != "x"]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            of = np.array(batch.column(group).to_pylist(), object) if group else np.full(len(x), None, object)
            out = []
            for n in names:
                p = np.full(len(x), np.nan)
                for g in set(of):
                    if (g, n) in models:
                        m, extra = models[g, n]
                        own = of == g
                        p[own] = boosting.predict(m, x[own] if extra is None else np.column_stack((x[own], np.full(own.sum(), extra))))
                out.append(pa.array(p, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out], schema.names)

    return rows.mapInArrow(run, schema)


def segment_scores(df: DataFrame, rounds: int = 500, depth: int = 6, most: int | None = TASK_ROWS, models: DataFrame | None = None) -> DataFrame:
    """(CustomerID, Segment, ChurnProbability, ChurnPrediction, RiskTier): each row scored by its segment's own model; null where there is none (too few rows, one class).

    The models of all segments travel to the tasks; there is one for each segment, of fixed size. A feature that the models know and ``df`` lacks is an error.
    """
    models = churn_models(df, rounds, depth, most=most) if models is None else models
    kept = models.select("Segment", "features", "model").collect()
    own = {(r["Segment"], "ChurnProbability"): (pickle.loads(r["model"]), None) for r in kept}  # noqa: S301 - written by this session
    names = kept[0]["features"] if kept else churn_features(df)
    out = _applied(_features(df, names, "CustomerID", "Segment"), own, "Segment", ["ChurnProbability"])
    p = F.col("ChurnProbability")
    return out.withColumn("ChurnPrediction", F.when(p.isNotNull(), is_true(p >= 0.5).cast("int"))).withColumn("RiskTier", risk_tier(p))


def model_drivers(df: DataFrame, models: DataFrame, n: int = 5) -> DataFrame:
    """(CustomerID, Segment, Drivers, TopDrivers): as ``scoring.top_drivers``, by the importances of the segment's own model; rows of segments without a model are left out."""
    from tidemark.operators.scoring import drivers_by_segment

    return drivers_by_segment(df, segment_importance(models).select("Segment", "feature", "importance"), churn_features(df), n)


def uplift_models(df: DataFrame, rounds: int = 200, depth: int = 4, most: int = FIT_ROWS) -> DataFrame:
    """(learner, model) of the treated (t1), the control (t0) and both (s): those that have both classes.

    They are fitted side by side, one in a task, each from about ``most`` labelled rows at most.
    """
    rows = _features(df, UPLIFT, "CustomerID", "Churn", "Treatment")
    every = rows.withColumn("learner", F.explode(F.array(F.concat(F.lit("t"), F.col("Treatment").cast("string")), F.lit("s"))))

    def train(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["draw", "CustomerID"])
        x, y = np.array(p["x"].tolist()), p["Churn"].to_numpy().astype(float)
        if len(set(y)) < 2:
            return _nothing("learner", "model")
        if p["learner"].iloc[0] == "s":
            x = np.column_stack((x, p["Treatment"].to_numpy().astype(float)))
        return pd.DataFrame({"learner": p["learner"].iloc[:1].to_list(), "model": [pickle.dumps(boosting.fit(x, y, np.ones(len(y)), rounds, depth))]})

    return _sampled(every, "learner", "Churn", most).groupBy("learner").applyInPandas(train, "learner string, model binary")


def uplift_scores(df: DataFrame, rounds: int = 200, depth: int = 4, most: int = FIT_ROWS, models: DataFrame | None = None) -> DataFrame:
    """(CustomerID, UpliftScore, ChurnProbNoTreatment): the mean of a two-model and a one-model learner, control less treated; zeros without both groups and classes in them. All rows are scored, by kept models or new ones."""
    rows = _features(df, UPLIFT, "CustomerID", "Churn", "Treatment")
    fits = {r[0]: pickle.loads(r[1]) for r in (uplift_models(df, rounds, depth, most) if models is None else models).collect()}  # noqa: S301 - at most three
    if not {"t0", "t1", "s"} <= fits.keys():
        return rows.select("CustomerID", F.lit(0.0).alias("UpliftScore"), F.lit(0.0).alias("ChurnProbNoTreatment"))
    models = {(None, "t1"): (fits["t1"], None), (None, "t0"): (fits["t0"], None), (None, "s1"): (fits["s"], 1.0), (None, "s0"): (fits["s"], 0.0)}
    out = _applied(rows.select("CustomerID", "x"), models, None, ["t1", "t0", "s1", "s0"])
    return out.select("CustomerID", (((F.col("t0") - F.col("t1")) + (F.col("s0") - F.col("s1"))) / 2).alias("UpliftScore"), F.col("t0").alias("ChurnProbNoTreatment"))
