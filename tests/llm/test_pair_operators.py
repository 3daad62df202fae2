"""Near-duplicates and nearest neighbours against brute force."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup, vptree
from tidemark.llm.neardup import Settings


def classes(rows, s=Settings()):
    """Classes by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(k for c in sets for k in c)
    n = len(rows)
    weight = [{k: v * (1 + s.idf * max(0, math.log((1 + n) / (1 + df[k])) / math.log(1 + n))) for k, v in c.items()} for c in sets]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, c in enumerate(sets):
        for k in c:
            holders[k].append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    texts = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        texts[t or ""].append(i)
    same = {(h[0], x) for h in texts.values() for x in h[1:]}
    for a, b in pairs | same:
        both = sum(min(weight[a][k], weight[b][k]) for k in weight[a].keys() & weight[b].keys())
        union = sum(weight[a].values()) + sum(weight[b].values()) - both
        if (a, b) in same or both / union >= s.similarity:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return sorted(tuple(sorted(x)) for x in out.values())


def test_classes_are_those_of_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = defaultdict(list)
    for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted(tuple(sorted(x)) for x in got.values()) == classes(rows)
    assert all(min(v) == k for k, v in got.items())


def test_a_large_group_of_near_copies(spark):
    """Far over ``small``: parts, hubs and a third band are all used."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 400))
    rows = []
    for i in range(150):
        text = list(base)
        for j in rng.choice(400, rng.integers(0, 5), replace=False):
            text[j] = f"own{i}x{j}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary, 300))) for i in range(100)] + [(2000 + i, rows[7][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in neardup.near_duplicates(df).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted(tuple(sorted(x)) for x in got.values()) == classes(rows)


@pytest.mark.parametrize("small", [2, 16])
def test_large_families_across_the_threshold(spark, small):
    """Half of each family are unlike its hub and like only the member they were edited from, which the hub may have linked."""
    rng = np.random.default_rng(5)
    rows = []

    def edited(text, n, name):
        text = list(text)
        for j in rng.choice(len(text), n, replace=False):
            text[j] = f"{name}x{j}"
        return text

    for f in range(2):
        near = [edited([f"f{f}w{j}" for j in range(200)], rng.integers(2, 6), f"f{f}n{i}") for i in range(150)]
        far = [edited(near[i], rng.integers(2, 5), f"f{f}m{i}") for i in range(150)]
        rows += [(f * 1000 + i, " ".join(t)) for i, t in enumerate(near + far)]
    got = defaultdict(list)
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), settings=Settings(small=small)).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted(tuple(sorted(x)) for x in got.values()) == classes(rows)


def test_undamped_weights_against_brute_force(spark):
    """Inverse document frequencies with their full weight, counted without collisions."""
    s = Settings(idf=1.0, sketch=1 << 24)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    edited = docs.filter("length(text) > 300 and doc_id < 60").select((F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_replace("text", r"^(\S+\s+\S+\s+)", "other words here ").alias("text"))
    rows = docs.unionByName(edited)
    got = defaultdict(list)
    for r in neardup.near_duplicates(rows, settings=s).collect():
        got[r["class_id"]].append(r["doc_id"])
    want = classes([tuple(r) for r in rows.collect()], s)
    assert sorted(tuple(sorted(x)) for x in got.values()) == want and sum(len(c) > 1 for c in want) > 20


def test_tricky_rows(tricky, empty):
    got = neardup.near_duplicates(tricky)
    assert got.count() == tricky.count() and got.filter("doc_id in (1, 2)").select("class_id").distinct().collect()[0][0] == 1
    kept = neardup.deduplicate(tricky)
    assert kept.columns == tricky.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 3, 5, 6, 7, 8]  # null and empty texts are one class, and so are the two rows of id 1 and that of id 2
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 32, 600, dtype=np.uint64).astype(np.uint32)
    w = rng.uniform(0.5, 3, 600)
    a, b = np.arange(0, 500), np.arange(100, 600)
    wb = w.copy()
    wb[100:300] *= 0.6
    want = np.minimum(w[100:500], wb[100:500]).sum() / (w[:100].sum() + np.maximum(w[100:500], wb[100:500]).sum() + wb[500:].sum())
    rows = np.repeat([0, 1], 500)
    got = neardup.samples(rows, np.concatenate((h[a], h[b])), np.concatenate((w[a], wb[b])), 2, 2000)
    assert abs((got[:, 0] == got[:, 1]).mean() - want) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (103, 100)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 104)}


def brute(ids, x, queries, top):
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        i = np.flatnonzero(ids == q)[0]
        score = (x @ x[i]) / (n * n[i])
        rest = np.flatnonzero(ids != q)
        out[q] = [ids[rest[k]] for k in np.lexsort((ids[rest], -score[rest].round(12)))[:top]]
    return out


@pytest.mark.parametrize("factor", [1.0, 1.05])
def test_neighbours(spark, factor, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    monkeypatch.setattr(vptree, "CELL_ROWS", 150)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 3)
    monkeypatch.setattr(vptree, "CHUNK", 2)
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(1500, 12)) + 4 * rng.normal(size=(10, 12))[rng.integers(0, 10, 1500)], np.tile(rng.normal(size=12), (700, 1))))
    ids = rng.permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 50 == 0, factor=factor).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert got == want if factor == 1 else hits > 0.9


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"), (5, [None, 1.0], "x"), (6, [float("inf"), 1.0], "x"), (7, [], "x"), (8, [0.0, 3.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (None, [1.0, 0.1], "x"), (50, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit(1)).withColumn("v", F.lit(2))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vptree.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 8), (50, 1, 0), (50, 2, 0), (50, 3, 1), (50, 4, 8)]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_multiples_tie_by_id(spark, monkeypatch):
    """40 multiples of one vector among others, negative ids with -1 among them: exact at factor 1, in trees of any size."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 41, (240, 16)).astype(float)
    rows = rng.permutation(240)[:40]
    x[rows] = x[rows[0]] * rng.integers(1, 60, 40)[:, None]
    ids = np.arange(240) - 60
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    unit = x / np.abs(x).max(axis=1)[:, None]
    score = (unit[:, None] * unit).sum(-1) / (vptree.norms(unit)[:, None] * vptree.norms(unit))
    for size in (50, 8192):
        monkeypatch.setattr(vptree, "SHARD_ROWS", size)
        monkeypatch.setattr(vptree, "CELL_ROWS", 2 * size)
        got = defaultdict(list)
        for r in vptree.nearest(df, F.lit(True), factor=1.0).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        for i, q in enumerate(ids):
            order = [k for k in np.lexsort((ids, -score[i])) if k != i][:5]
            assert got[q] == [(ids[k], score[i][k]) for k in order]


def test_own_rows_leave_room_for_others(spark):
    """A query's id on many rows, near and equal ones: the nearest of the others are still found."""
    rows = [(0, [1.0, 0.001 * i]) for i in range(20)] + [(0, [1.0, 0.5])] * 9 + [(5, [1.0, 0.5])] * 3 + [(7, [2.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0])]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, factor=1.0).orderBy("rank").collect()
    assert len(got) == 5 and {r["vec_id"] for r in got} <= {5, 7, 8, 9} and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_queries_visit_few_cells_of_clustered_vectors(spark, monkeypatch):
    """At factor 1, so nothing is lost: of the (query, cell) pairs, a small share is visited."""
    monkeypatch.setattr(vptree, "CELL_ROWS", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] * 5 + 0.3 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    pairs, cells = [], []
    routed, index = vptree.routed, vptree.build_index
    monkeypatch.setattr(vptree, "build_index", lambda *a: cells.append(index(*a)) or cells[-1])
    monkeypatch.setattr(vptree, "routed", lambda *a: pairs.append(routed(*a)) or pairs[-1])
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == brute(np.arange(3000), x, range(0, 3000, 20), 5)
    n = sum(int((s > 0).sum()) for s in cells[0][1].shards.values())
    assert n == 50 and pairs[0].count() < 0.35 * 150 * n


def test_recall_on_the_table(spark):
    from tidemark.llm.queries import QUERIES

    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    got = defaultdict(set)
    for r in QUERIES["op6_vantage_point_trees"](spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute(t["vec_id"].to_numpy(), np.array(t["embedding"].tolist(), float), list(got), 5)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
