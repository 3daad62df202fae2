"""Exact top-k by inner product: Fagin's threshold algorithm over lists that are sorted by dimension."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block, on average, and shards that a task visits one after the other: what it has found in one bounds its reading of the next.
SHARD_ROWS, BLOCK_ROWS, GROUP = 4096, 256, 8
#: Entries of each list that the first round reads, and how much deeper each further round goes.
FIRST, DEEPER = 8, 4
LEAST, MOST = -(2**63), 2**63 - 1


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest signed type."""
    most = max(int(x.max()), -int(x.min()) - 1) if x.size else 0
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


@dataclass
class Lists:
    """Rows with their vectors, how many such rows there are, and for each dimension the rows from its largest value down."""

    ids: np.ndarray
    times: np.ndarray
    v: np.ndarray
    order: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Lists:
        with np.load(io.BytesIO(blob)) as z:
            return Lists(**{k: z[k] for k in z.files})


def sorted_lists(ids: np.ndarray, times: np.ndarray, v: np.ndarray) -> Lists:
    order = np.argsort(v, axis=0, kind="stable")[::-1].T
    return Lists(ids, times, narrow(v), np.ascontiguousarray(order.astype(np.uint16 if len(v) <= 1 << 16 else np.uint32)))


class Best:
    """The ``top`` best rows that one query has met, other than its own, in the order of the result."""

    def __init__(self, own: int, top: int) -> None:
        self.own, self.top, self.rows = own, top, []

    def least(self):
        """The score that a further row must reach; None while any will do."""
        return -self.rows[-1][0] if len(self.rows) == self.top else None

    def meet(self, scores: np.ndarray, ids: np.ndarray, times: np.ndarray) -> None:
        use = ids != self.own
        if self.least() is not None:
            use &= scores >= self.least()
        at = np.flatnonzero(use)
        if len(at) > 4 * self.top:
            s = scores[at]
            at = at[s >= np.partition(s, len(s) - self.top)[len(s) - self.top]]
        new = [(-int(scores[i]), int(ids[i])) for i in at for _ in range(times[i])]
        self.rows = sorted(self.rows + new)[: self.top]


def visit(lists: Lists, q: np.ndarray, best: list[Best]) -> int:
    """The threshold algorithm for queries ``q`` [queries x dimensions] on one shard; returns the rows that were scored.

    Round by round, each query reads its lists further: from the top where its component is positive, from the bottom where it is negative, and not at all where it is 0. Rows that it meets for
    the first time are scored in full. No row that it hasn't met can score above the sum of the products at its lists' present places, so it stops when that is below its worst kept score. Equal
    scores go by id, so it reads on while the bound equals that score.
    """
    n, dims = lists.v.shape
    most = int(np.abs(lists.v.astype(object)).max()) * int(np.abs(q.astype(object)).max()) * dims if n and q.size else 0
    kind = np.float64 if most < 2**53 else object  # sums below 2 ** 53 are exact in doubles
    v, q = lists.v.astype(kind), q.astype(kind)
    by_rank = np.take_along_axis(v.T, lists.order.astype(np.int64), 1)
    high, low = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    up, down = [np.flatnonzero(x > 0) for x in q], [np.flatnonzero(x < 0) for x in q]
    bound = lambda rows, depth: high[rows] @ by_rank[:, depth - 1] + low[rows] @ by_rank[:, n - depth]

    def open_(rows: np.ndarray, depth: int) -> np.ndarray:
        limit = bound(rows, depth)
        return rows[[best[i].least() is None or t >= best[i].least() for i, t in zip(rows, limit)]]

    active = open_(np.arange(len(q)), 1)
    seen = np.zeros((len(q), n), bool)
    depth, scored = 0, 0
    while len(active) and depth < n:
        last, depth = depth, min(n, max(FIRST, depth * DEEPER))
        for i in active:
            met = np.zeros(n, bool)
            if len(up[i]) + len(down[i]) == 0 or depth == n:
                met[:] = True  # all rows score 0, or all have been read
            else:
                met[lists.order[up[i], last:depth].ravel()] = True
                met[lists.order[down[i], n - depth : n - last].ravel()] = True
            new = np.flatnonzero(met & ~seen[i])
            seen[i, new] = True
            scored += len(new)
            best[i].meet(v[new] @ q[i], lists.ids[new], lists.times[new])
        active = open_(active, depth)
    return scored


def largest_products(df: DataFrame, query: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of largest inner product for each row that ``query`` marks, ties to smaller ids.

    Components become ``floor(scale * x)`` in double precision (held within 64 bits); products are exact integers (a score beyond 64 bits is given as the nearest one within). Every row is compared but the query's own:
    nothing is approximate. Rows are dealt by a hash of their vector to shards of about 4096, each with its sorted lists; tasks take eight shards and 256 queries, so a query brings five rows from 32,768 at most,
    and what it has found in one shard lets it stop sooner in the next. Equal vectors keep the smallest ids that a result can need, before any shuffle of them all.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; vectors of another length than a query are not compared with it. A repeated id is one query, by
    the smallest of its vectors; its rows are not its own neighbours, but each is one to others. Fewer rows than ``top``: all of them. No rows: no rows. Further columns are ignored.
    """
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    wrong = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~wrong)
    rows = rows.select("vec_id", "is_query", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    total, asked = df.agg(F.count("*"), F.count_if(query)).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    groups = -(-shards // GROUP)

    # Of a vector, the smallest ids: whichever a query leaves out as its own, enough remain.
    held = rows.groupBy("dim", "v", "vec_id").agg(F.least(F.count("*"), F.lit(top)).alias("times"))
    nth = F.dense_rank().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    held = held.withColumn("nth", nth).filter(F.col("nth") <= top + 1).withColumn("shard", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(shards)))

    def matrix(t: pa.Table) -> np.ndarray:
        return t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)

    def index(t: pa.Table) -> pa.Table:
        got = sorted_lists(t["vec_id"].to_numpy(), t["times"].to_numpy(), matrix(t))
        return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], "lists": pa.array([got.dump()], pa.binary())})

    lists = held.groupBy("dim", "shard").applyInArrow(index, "dim int, shard long, lists binary")
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)))

    def search(shards_: Iterator[pa.Table], asked_: pa.Table) -> pa.Table:
        ids, q = asked_["vec_id"].to_numpy(), matrix(asked_)
        best = [Best(i, top) for i in ids.tolist()]
        for blob in shards_:
            visit(Lists.load(blob), q, best)
        found = [(b.own, i, min(MOST, max(LEAST, -s))) for b in best for s, i in b.rows]
        return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("query_id", "vec_id", "score"))})

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["shard"].to_numpy()) if len(right) else []
        return search((left["lists"][int(i)].as_py() for i in order), right)

    # The stated queries against all rows, in blocks.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    key = ["dim", "group", "block"]
    left = lists.withColumn("group", F.expr(f"shard div {GROUP}")).withColumn("block", every(blocks)).groupBy(*key)
    right = queries.withColumn("group", every(groups)).groupBy(*key)
    found = left.cogroup(right).applyInArrow(task, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
