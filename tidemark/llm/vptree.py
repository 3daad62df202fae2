"""Nearest neighbours by cosine: vantage points part the rows into shards, and a vantage-point tree each shard; both are pruned by the triangle inequality."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

#: Points of one shard's tree and queries of one block, on average; so many blocks visit a tree together, so a tree is sent and loaded once for all of them.
SHARD_ROWS, BLOCK_ROWS, CHUNK = 8192, 2048, 8
#: Directions for each pivot, on average, and the most pivots.
CELL_ROWS, MOST_CELLS = 4096, 1024
LEAF = 96
#: Rounding of chords between unit vectors (it is largest near 0, where the root of an error of 1e-15 is 3e-8) and of cosines.
CHORD_SLACK, COSINE_SLACK = 2e-7, 1e-13


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


@dataclass
class Tree:
    """Distinct directions in tree order; those of point i have the ids ``ids[first[i] : first[i + 1]]``. A node spans points lo to hi; leaves have no children.

    Distances are chords between unit vectors, a metric that orders as the cosine does. ``near`` and ``far`` bound the distances from the node's vantage
    point to the points of its inner and outer child. ``single`` marks points of one id only.
    """

    x: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    single: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    vantage: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Tree:
        with np.load(io.BytesIO(blob)) as z:
            return Tree(**{k: z[k] for k in z.files})


def build(points: np.ndarray, ids: list[np.ndarray]) -> Tree:
    """A tree over distinct points, each with its ids in ascending order."""
    unit = points / norms(points)[:, None]
    perm = np.arange(len(unit))
    nodes: list[list] = []
    rng = np.random.default_rng(5)
    todo = [(0, len(unit))]
    places: dict[tuple[int, int], int] = {}
    while todo:
        lo, hi = todo.pop()
        node = places[lo, hi] = len(nodes)
        nodes.append([lo, hi, -1, -1, 0, (0.0, 0.0), (0.0, 0.0)])
        if hi - lo <= LEAF:
            continue
        rows = perm[lo:hi]
        vp = int(rows[rng.integers(hi - lo)])
        d = np.sqrt(np.maximum(0, 2 - 2 * (unit[rows] @ unit[vp])))
        half = (hi - lo) // 2
        part = np.argpartition(d, half)
        perm[lo:hi], d = rows[part], d[part]
        nodes[node][2:] = [(lo, lo + half), (lo + half, hi), vp, (d[:half].min(), d[:half].max()), (d[half:].min(), d[half:].max())]
        todo += [(lo, lo + half), (lo + half, hi)]
    child = np.array([[places.get(n[2], -1), places.get(n[3], -1)] if n[2] != -1 else [-1, -1] for n in nodes]).reshape(-1, 2)
    place = np.empty(len(perm), np.int64)
    place[perm] = np.arange(len(perm))
    own = [ids[i] for i in perm]
    return Tree(
        points[perm], np.concatenate(own), np.concatenate(([0], np.cumsum([len(i) for i in own]))), np.array([i[0] == i[-1] for i in own]),
        np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), child[:, 0], child[:, 1],
        np.array([place[n[4]] for n in nodes]), np.array([n[5] for n in nodes]), np.array([n[6] for n in nodes]),
    )


def search(tree: Tree, query_ids: np.ndarray, q: np.ndarray, top: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of up to ``top`` nearest rows of each query, without its own id.

    A first walk finds each query's ``top``-th best cosine, a second one collects all points that reach it, rounding allowed for; these are scored in one fixed
    way and cut by score, then id. A child is left out when its least possible distance times ``factor`` is above the worst kept distance: 1 is exact, more is faster.
    """
    n, keep = len(q), min(top, len(tree.x))
    norm_q, norm_x = norms(q), norms(tree.x)
    unit, points = q / norm_q[:, None], tree.x / norm_x[:, None]
    only = tree.ids[tree.first[:-1]]
    best = np.full((n, keep), -np.inf)

    def cosines(leaf: int, rows: np.ndarray) -> np.ndarray:
        """Of a leaf's points; a point that holds no other id than the query's doesn't count."""
        lo, hi = tree.lo[leaf], tree.hi[leaf]
        c = unit[rows] @ points[lo:hi].T
        c[tree.single[lo:hi] & (only[lo:hi] == query_ids[rows, None])] = -np.inf
        return c

    def visit(leaf: int, rows: np.ndarray) -> None:
        both = np.concatenate((best[rows], cosines(leaf, rows)), axis=1)
        best[rows] = -np.partition(-both, keep - 1, axis=1)[:, :keep]

    def distance(node: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (unit[rows] @ points[tree.vantage[node]])))

    def walk(leave, rows_of_leaf) -> None:
        """Visit the leaves that may hold points within each query's ``leave`` distance."""
        todo = [(0, np.arange(n))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if tree.inner[node] < 0:
                rows_of_leaf(node, rows)
                continue
            d, worst = distance(node, rows), leave(rows)
            for child, (least, most) in ((tree.outer[node], tree.far[node]), (tree.inner[node], tree.near[node])):
                bound = np.maximum(0, np.maximum(d - most, least - d) - CHORD_SLACK)
                todo.append((child, rows[bound * factor <= worst]))

    def worst(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * best[rows].min(axis=1)) + 4 * COSINE_SLACK)

    # First each query's own leaf, for a bound to prune by; then all leaves that may hold nearer points.
    home = np.zeros(n, np.int64)
    todo = [(0, np.arange(n))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if tree.inner[node] < 0:
            home[rows] = node
            visit(node, rows)
            continue
        inside = distance(node, rows) <= (tree.near[node, 1] + tree.far[node, 0]) / 2
        todo += [(tree.inner[node], rows[inside]), (tree.outer[node], rows[~inside])]

    def elsewhere(leaf: int, rows: np.ndarray) -> None:
        rows = rows[home[rows] != leaf]
        if len(rows):
            visit(leaf, rows)

    walk(worst, elsewhere)
    least = best.min(axis=1) - COSINE_SLACK
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def collect(leaf: int, rows: np.ndarray) -> None:
        row, at = np.nonzero(cosines(leaf, rows) >= np.maximum(least[rows], -2)[:, None])
        found.append((rows[row], at + tree.lo[leaf]))

    walk(worst, collect)
    row, at = (np.concatenate(x) for x in zip(*found))
    score = np.concatenate([(q[row[i : i + 65536]] * tree.x[at[i : i + 65536]]).sum(axis=-1) for i in range(0, len(row), 65536)] or [np.zeros(0)]) / (norm_q[row] * norm_x[at])
    times = np.diff(tree.first)[at]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    ids = tree.ids[np.repeat(tree.first[at], times) + nth]
    row, score = np.repeat(row, times), np.repeat(score, times)
    use = ids != query_ids[row]
    row, ids, score = row[use], ids[use], score[use]
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    near = np.arange(len(row)) - np.searchsorted(row, row) < top
    return row[near], ids[near], score[near]


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, v, is_query) of usable rows: v holds the vector over its largest absolute component, as bytes of doubles.

    Division is rounded correctly, so exact multiples of a vector have the same bytes, and the same scores.
    """
    for batch in batches:
        lists = batch.column("v").cast(pa.list_(pa.float64()))
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(size)))
        some = size > 0
        good, most = np.zeros(len(size), bool), np.ones(len(size))
        if some.any():
            most[some] = np.maximum.reduceat(np.abs(x), at[:-1][some])  # nan and inf stay
            good[some] = np.isfinite(most[some]) & (most[some] > 0)
        most[~good] = 1
        raw = (x / np.repeat(most, size) + 0.0).astype("<f8").tobytes()
        keep = np.flatnonzero(good & ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False))
        blobs = pa.array([raw[8 * at[i] : 8 * at[i + 1]] for i in keep], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array(size[keep].astype(np.int32)), blobs, batch.column("is_query").take(pa.array(keep))], ["vec_id", "dim", "v", "is_query"])


@dataclass
class Cells:
    """What the tasks know of all shards: each cell's pivot (a unit vector), the distance of its farthest direction, and how many shards it has; by vector length. Bounded by ``MOST_CELLS``."""

    pivots: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    shards: dict[int, np.ndarray]

    def far(self, dim: int, unit: np.ndarray) -> np.ndarray:
        """[vectors x cells] chords to the pivots; vectors of a length without pivots have one cell, at no distance."""
        if dim not in self.pivots:
            return np.zeros((len(unit), 1))
        return np.sqrt(np.maximum(0, 2 - 2 * (unit @ self.pivots[dim].T)))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length of a batch: its rows and their unit vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        x = np.frombuffer(b"".join(batch.column("v").take(pa.array(rows)).to_pylist()), "<f8").reshape(len(rows), -1)
        yield int(dim), rows, x / norms(x)[:, None]


def _nearest_cell(df: DataFrame, cells: Cells) -> DataFrame:
    """``df`` (dim, v, ...) with the cell of the nearest pivot and the distance to it."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim, rows, unit in _by_dim(batch):
                d = cells.far(dim, unit)
                cell[rows] = d.argmin(axis=1)
                far[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], schema.names)

    return df.mapInArrow(run, schema)


def build_index(rows: DataFrame, top: int) -> tuple[DataFrame, Cells]:
    """(dim, cell, shard, tree) of all directions, and their cells.

    Pivots are directions drawn by hash, one for each ``CELL_ROWS`` rows and at most ``MOST_CELLS``; every direction goes to the cell of its nearest pivot, and a cell is cut by hash to shards of about ``SHARD_ROWS``
    directions, which share the cell's ball.
    """
    # Of a direction, the smallest ids: whichever a query leaves out as its own, enough remain.
    held = rows.groupBy("dim", "v", "vec_id").agg(F.least(F.count("*"), F.lit(top)).alias("n"))
    nth = F.dense_rank().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    held = written(held.withColumn("nth", nth).filter(F.col("nth") <= top + 1))
    one = held.filter("nth = 1")
    n = min(MOST_CELLS, max(1, one.count() // CELL_ROWS))
    drawn: dict[int, list[np.ndarray]] = {}
    for r in one.select("dim", "v").orderBy(F.xxhash64("v", F.lit(5)), "v").limit(n).collect():
        drawn.setdefault(r["dim"], []).append(np.frombuffer(r["v"], "<f8"))
    cells = Cells({d: np.array(v) / norms(np.array(v))[:, None] for d, v in drawn.items()}, {}, {})

    placed = written(_nearest_cell(held.drop("nth"), cells))
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row for each cell
        k = len(cells.pivots.get(r["dim"], [0]))
        cells.radius.setdefault(r["dim"], np.full(k, -np.inf))[r["cell"]] = r["far"] if r["dim"] in cells.pivots else np.inf
        cells.shards.setdefault(r["dim"], np.zeros(k, np.int64))[r["cell"]] = -(-r["n"] // SHARD_ROWS)

    def index(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["v", "vec_id"], ignore_index=True)
        new = np.flatnonzero((p["v"] != p["v"].shift()).to_numpy())
        points = np.frombuffer(b"".join(p["v"][new]), "<f8").reshape(len(new), -1)
        ids = np.repeat(p["vec_id"].to_numpy(), p["n"].to_numpy())
        ends = np.cumsum(p["n"].to_numpy())
        tree = build(points, np.split(ids, ends[new[1:] - 1]))
        return pd.DataFrame({"dim": p["dim"][:1], "cell": p["cell"][:1], "shard": p["shard"][:1], "tree": [tree.dump()]})

    dealt = placed.join(_shards_of(rows.sparkSession, cells), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("v", F.lit(1)), "shards"))
    trees = dealt.groupBy("dim", "cell", "shard").applyInPandas(index, "dim int, cell int, shard long, tree binary")
    return written(trees), cells


def _shards_of(spark, cells: Cells) -> DataFrame:
    """(dim, cell, shards), to be broadcast: at most ``MOST_CELLS`` rows, and one for each vector length without pivots."""
    rows = [(d, c, int(n)) for d, per in cells.shards.items() for c, n in enumerate(per) if n]
    return F.broadcast(spark.createDataFrame(rows, "dim int, cell int, shards long"))


def routed(queries: DataFrame, cells: Cells, factor: float) -> DataFrame:
    """(vec_id, dim, v, cell): the cells, other than its home, that may hold a nearer row than the ``worst`` that a query has found (null: any row will do), by the triangle inequality.

    A cell is left out when its least possible distance, that to its pivot less its radius, times ``factor`` is above the worst kept distance: with factor 1 nothing is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(float)
            home = batch.column("cell").to_numpy()
            for dim, rows, unit in _by_dim(batch):
                if dim not in cells.radius:
                    continue
                least = np.maximum(0, cells.far(dim, unit) - cells.radius[dim] - 2 * CHORD_SLACK)
                kept = np.where(np.isnan(worst[rows]), np.inf, np.sqrt(np.maximum(0, 2 - 2 * worst[rows]) + 4 * COSINE_SLACK))
                go = (least * factor <= kept[:, None]) & (cells.shards[dim] > 0)
                go[np.arange(len(rows)), home[rows]] = False
                row, cell = np.nonzero(go)
                for i in range(0, len(row), 10_000):
                    part = batch.take(pa.array(rows[row[i : i + 10_000]]))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), part.column("v"), pa.array(cell[i : i + 10_000].astype(np.int32))], ["vec_id", "dim", "v", "cell"])

    return queries.mapInArrow(run, "vec_id long, dim int, v binary, cell int")


def visited(pairs: DataFrame, trees: DataFrame, cells: Cells, top: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): up to ``top`` nearest rows of each query (vec_id, dim, v) in each shard of the cell it is sent to. A shard's queries come in chunks of bounded size."""

    def find(key: tuple, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        asked = asked.sort_values("vec_id", ignore_index=True)
        for blob in tree["tree"] if len(asked) else ():
            t = Tree.load(blob)
            for i in range(0, len(asked), BLOCK_ROWS):
                part = asked[i : i + BLOCK_ROWS]
                ids = part["vec_id"].to_numpy()
                row, near, score = search(t, ids, np.frombuffer(b"".join(part["v"]), "<f8").reshape(len(ids), -1), top, factor)
                out.append(pd.DataFrame({"query_id": ids[row], "vec_id": near, "score": score}))
        return pd.concat(out)

    pairs = written(pairs)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked_of = [tuple(r) for r in pairs.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (BLOCK_ROWS * CHUNK)).alias("chunks")).collect()]  # one row for each cell
    chunks = lambda: F.broadcast(pairs.sparkSession.createDataFrame(asked_of, "dim int, cell int, chunks long"))
    key = ["dim", "cell", "shard", "chunk"]
    left = trees.join(chunks(), ["dim", "cell"]).withColumn("chunk", every("chunks")).groupBy(*key)
    right = pairs.join(chunks(), ["dim", "cell"]).join(_shards_of(pairs.sparkSession, cells), ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(2)), "chunks")).withColumn("shard", every("shards")).groupBy(*key)
    return left.cogroup(right).applyInPandas(find, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, query: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = 5, factor: float = 1.05) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of largest cosine for each row that ``query`` marks, nearest first, ties to smaller ids.

    Every direction is indexed, in a tree of its shard; shards are parts of the balls around at most 1,024 pivots. A query first visits the shards of its nearest pivot; what it finds there bounds its search, and the
    triangle inequality tells which other balls can hold something nearer. On vectors in clusters most shards are never visited; where distances hardly differ, all are.
    Rows of one direction are one point of a tree with its smallest ids, so they cost nothing and ties are right; they are brought together before any shuffle of them all. Directions that
    differ are compared by their scores in double precision. With factor 1 the result is that of comparing all pairs.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of another length than a query are not
    compared with it. A repeated id is one query, by the smallest of its vectors; its rows are not its own neighbours, but each is one to others. Ids may have either sign.
    Fewer rows than ``top``: all of them. No rows: no rows.
    """
    given = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))
    rows = written(given.mapInArrow(_directions, "vec_id long, dim int, v binary, is_query boolean"))
    trees, cells = build_index(rows, top)
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*")
    queries = written(_nearest_cell(queries, cells))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= top)
    home = written(best(visited(queries.select("vec_id", "dim", "v", "cell"), trees, cells, top, factor)))
    worst = home.groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("worst")).withColumnRenamed("query_id", "vec_id")
    others = visited(routed(queries.join(worst, "vec_id", "left"), cells, factor), trees, cells, top, factor)
    return best(home.drop("rank").unionByName(others)).select("query_id", "rank", "vec_id", "score")
