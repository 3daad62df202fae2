"""Boosted symmetric trees on all labelled rows: sums of gradients by task, splits on the driver, many fits in the same passes.

The trees are those of ``boosting``, so its ``predict`` applies. A fit is a group of rows with a training mask (a segment's whole training part, or that without one fold). All fits advance level by level:
a pass over packed blocks of binned rows gives every fit's sums of gradients by (node, feature, bin), of the lighter half of each node; those of the other half are what is left of the node. The driver picks each
fit's best split. What reaches the driver has a fixed size for each fit and task, or for each fit where tasks are many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.operators import boosting
from tidemark.operators.boosting import BINS, binned, grown, nodes
from tidemark.operators.ranks import ACCURACY
from tidemark.sources.stage import written

#: Trees after which the rows' margins are written, so that a pass applies at most so many.
KEPT = 16
#: Rows of a group that are packed together, and tasks whose sums the driver adds up itself.
BLOCK, FEW_TASKS = 8192, 16


@dataclass
class Fit:
    """One fit: the rows of ``group`` whose fold isn't ``out`` (None: all training rows), and what is known of it so far."""

    group: str
    out: int | None
    rounds: int
    start: float = 0.0
    splits: list[list[tuple[int, int]]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' features; unknown ones count as 0, and zeros have no sign."""
    x = batch.column("x")
    return np.nan_to_num(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float)) + 0.0


def _of_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    g = np.array(batch.column("g").to_pylist(), object)
    for name in sorted(set(g)):
        yield name, np.flatnonzero(g == name)


def cut_points(rows: DataFrame, group: str, width: int) -> dict[str, list[np.ndarray]]:
    """Bin edges by group and column: distinct quantiles of all values (unknown ones count as 0), as ``boosting.edges`` has them.

    Sketches of fixed size bracket each quantile; all rows below a bracket are counted and the values within it are counted one by one, so the edges are exact. A bracket that misses its quantile is made wider.
    """
    rows = rows.select(F.col(group).alias("g"), "x")
    qs = np.linspace(0, 1, BINS + 1)[1:-1]
    x = lambda i: F.nanvl(F.coalesce(F.col("x")[i], F.lit(0.0)), F.lit(0.0))
    ps = [float(min(1.0, max(0.0, q + d))) for d in (-2.0 / ACCURACY, 2.0 / ACCURACY) for q in qs]
    got = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(x(i), ps, ACCURACY).alias(f"q{i}") for i in range(width)]).collect()  # one row for each group
    at = {r["g"]: (r["n"] - 1) * qs for r in got}
    most = np.finfo(float).max
    ends = {r["g"]: np.clip([r[f"q{i}"] for i in range(width)], -most, most).reshape(width, 2, len(qs)) for r in got}
    open_ = {g: np.ones((width, len(qs)), bool) for g in ends}
    values: dict[str, np.ndarray] = {g: np.zeros((2, width, len(qs))) for g in ends}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = {g: np.zeros(o.shape, np.int64) for g, o in open_.items()}

        def out(g: str, i: np.ndarray, k: np.ndarray, v: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(k, pa.int32()), v, pa.array(n, pa.int64())], ["g", "i", "k", "v", "n"])

        for batch in batches:
            m = _matrix(batch)
            for g, own in _of_group(batch):
                for i in range(width):
                    ks = np.flatnonzero(open_[g][i])
                    each, n = np.unique(m[own, i], return_counts=True)
                    first, last = np.searchsorted(each, ends[g][i, 0, ks], "left"), np.searchsorted(each, ends[g][i, 1, ks], "right")
                    below[g][i, ks] += np.concatenate(([0], np.cumsum(n)))[first]
                    many = last - first
                    which = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    yield out(g, np.full(len(which), i), np.repeat(ks, many), pa.array(each[which], pa.float64()), n[which])
        for g, b in below.items():
            i, k = np.nonzero(open_[g])
            yield out(g, i, k, pa.nulls(len(i), pa.float64()), b[i, k])

    while any(o.any() for o in open_.values()):
        cells = rows.mapInArrow(counted, "g string, i int, k int, v double, n long").groupBy("g", "i", "k", "v").agg(F.sum("n").alias("n"))
        upto = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "i", "k").orderBy(F.asc_nulls_first("v"))))  # over one bracket's values
        ranks = rows.sparkSession.createDataFrame([(g, k, int(np.floor(a)), int(np.ceil(a))) for g, all_ in at.items() for k, a in enumerate(all_)], "g string, k int, low long, high long")
        holds = lambda r: (F.col("upto") > F.col(r)) & (F.col("upto") - F.col("n") <= F.col(r))
        found = upto.join(F.broadcast(ranks), ["g", "k"]).filter("v is not null").select("g", "i", "k", "v", holds("low").alias("low"), holds("high").alias("high")).filter("low or high")
        missing = {g: np.stack((o, o)) for g, o in open_.items()}
        for r in found.collect():  # two rows at most for each quantile
            for side, there in enumerate((r["low"], r["high"])):
                if there:
                    values[r["g"]][side, r["i"], r["k"]], missing[r["g"]][side, r["i"], r["k"]] = r["v"], False
        for g in open_:
            open_[g] = missing[g].any(axis=0)
            ends[g][:, 0][open_[g]], ends[g][:, 1][open_[g]] = -most, most
    out = {}
    for g, (low, high) in values.items():
        part = at[g] - np.floor(at[g])
        out[g] = [np.unique(np.where(part < 0.5, low[i] + (high[i] - low[i]) * part, high[i] - (high[i] - low[i]) * (1 - part))) for i in range(width)]
    return out


def _margin(trees: list, b: np.ndarray) -> np.ndarray:
    """What trees add to the margin of rows, given by feature."""
    out = np.zeros(b.shape[1])
    for split, leaf in trees:
        out += leaf[nodes(split, b)]
    return out


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """(group, labels, weights, folds, bins by feature, margins by kind) of each block of a batch."""
    for g, y, w, fold, b, margin in zip(*(batch.column(c) for c in ("g", "y", "weight", "fold", "b", "margin"))):
        w = np.frombuffer(w.as_buffer(), "<f8")
        yield g.as_py(), np.frombuffer(y.as_buffer(), np.uint8), w, np.frombuffer(fold.as_buffer(), "<i2"), np.frombuffer(b.as_buffer(), np.uint8).reshape(width, -1), np.frombuffer(margin.as_buffer(), "<f8").reshape(-1, len(w))


def packed(rows: DataFrame, cuts: dict[str, list[np.ndarray]], kinds: int) -> DataFrame:
    """Blocks of ``BLOCK`` rows of a group at most, as bytes: labels, weights, folds, bins by feature, margins (zeros) by kind of fit."""

    def block(name: str, parts: list[tuple]) -> pa.RecordBatch:
        y, w, fold, b = (np.concatenate(p, axis=-1) for p in zip(*parts))
        values = [name, y.astype(np.uint8).tobytes(), w.astype("<f8").tobytes(), fold.astype("<i2").tobytes(), np.ascontiguousarray(b, np.uint8).tobytes(), np.zeros((kinds, len(y))).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.string(), *[pa.binary()] * 5])], ["g", "y", "weight", "fold", "b", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for whole in batches:
            for i in range(0, len(whole), BLOCK):
                batch = whole.slice(i, BLOCK)
                m = _matrix(batch)
                y, w, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "fold"))
                for name, own in _of_group(batch):
                    parts = held.get(name, [])
                    if sum(len(p[0]) for p in parts) + len(own) > BLOCK:
                        yield block(name, held.pop(name))
                    held.setdefault(name, []).append((y[own], w[own], fold[own], binned(m[own], cuts[name]).T))
        for name, parts in held.items():
            yield block(name, parts)

    return rows.mapInArrow(run, SHAPE)


SHAPE = "g string, y binary, weight binary, fold binary, b binary, margin binary"


def fit_all(rows: DataFrame, group: str, label: str, rounds: int, depth: int, folds: int = 0, fold_rounds: int = 0, rate: float = 0.05, l2: float = 3.0) -> dict[tuple[str, int | None], dict]:
    """(group, left-out fold or None) to a model of ``boosting``, fitted on all rows.

    ``rows`` has the group, the label (0 or 1), ``weight``, ``fold`` (the fold that a row is left out of) and ``x``, an array of features. A fit without both classes is left out. The groups are few (segments):
    models and sums of every group pass through the driver, whose parts have the same size whatever the number of rows. A group's fits share the edges of its whole training part.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(label).cast("double").alias("y"), F.col("weight").cast("double"), F.col("fold").cast("int"), "x")
    rows = written(rows)
    counts = rows.groupBy("g", "fold").agg(F.sum(F.col("weight") * F.col("y")).alias("p"), F.sum("weight").alias("w"), F.sum("y").alias("n1"), F.count("*").alias("n"), F.max(F.size("x")).alias("width")).toPandas()  # groups x folds
    if counts.empty:
        return {}
    width = int(counts["width"].max())
    fits: list[Fit] = []
    for g in sorted(counts["g"].unique()):
        own = counts[counts["g"] == g]
        for out in [None, *range(folds)]:
            part = own if out is None else own[own["fold"] != out]
            if 0 < part["n1"].sum() < part["n"].sum():
                mean = part["p"].sum() / part["w"].sum()
                fits.append(Fit(g, out, rounds if out is None else fold_rounds, float(np.log(mean / (1 - mean))), gain=np.zeros(width)))
    if not fits:
        return {}
    cuts = cut_points(rows, "g", width)
    bins = {g: [len(c) + 1 for c in own] for g, own in cuts.items()}
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    dealt = lambda t: written(t).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    table = dealt(packed(rows, cuts, folds + 1))
    kept = 0

    def sums(active: list[int], partial: dict[int, list[tuple[int, int]]], lighter: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each active fit, [2, nodes before the last split, bins of all features]: sums of gradients and Hessians over the lighter half of each node, or over all rows where no split is made yet."""
        todo: dict[str, list[tuple]] = {}
        for k in active:
            f = fits[k]
            todo.setdefault(f.group, []).append((k, f.out, f.start, list(zip(f.splits[kept:], f.leaves[kept:])), partial[k], lighter.get(k)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for g, y, w, fold, b, margin in _blocks(batch, width):
                    for k, out, start, trees, split, light in todo.get(g, []):
                        node, use = nodes(split, b), np.ones(len(y), bool) if out is None else fold != out
                        if light is not None:
                            node, use = node >> 1, use & ((node & 1) == light[node >> 1])
                        own = np.flatnonzero(use)
                        bb = b[:, own]
                        p = 1 / (1 + np.exp(-(start + margin[0 if out is None else out + 1][own] + _margin(trees, bb))))
                        got = boosting.sums(bb, node[own], w[own] * (p - y[own]), w[own] * p * (1 - p), bins[g], 1 if light is None else len(light))
                        total[k] = total[k] + got if k in total else got
            for k, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype("<f8").tobytes()])], ["fit", "sums"])

        def add(p: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"fit": p["fit"][:1], "sums": [sum(np.frombuffer(s, "<f8") for s in p["sums"]).tobytes()]})

        parts = table.mapInArrow(run, "fit int, sums binary")
        if tasks > FEW_TASKS:
            parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("fit", "part").applyInPandas(add, "fit int, sums binary").groupBy("fit").applyInPandas(add, "fit int, sums binary")
        total: dict[int, np.ndarray] = {}
        for r in parts.collect():
            got = np.frombuffer(r["sums"], "<f8")
            total[r["fit"]] = total[r["fit"]] + got if r["fit"] in total else got
        return {k: v.reshape(2, -1, sum(bins[fits[k].group])) for k, v in total.items()}

    def keep_margins() -> DataFrame:
        todo: dict[str, list[tuple]] = {}
        for f in fits:
            todo.setdefault(f.group, []).append((0 if f.out is None else f.out + 1, list(zip(f.splits[kept:], f.leaves[kept:]))))
        kinds = folds + 1 if r + 1 < fold_rounds else 1  # those of finished folds aren't needed any more

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = []
                for g, _, _, _, b, margin in _blocks(batch, width):
                    margin = margin[:kinds].copy()
                    for kind, trees in todo.get(g, []):
                        if kind < kinds:
                            margin[kind] += _margin(trees, b)
                    new.append(margin.tobytes())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("g", "y", "weight", "fold", "b")], pa.array(new, pa.binary())], ["g", "y", "weight", "fold", "b", "margin"])

        return dealt(table.mapInArrow(run, SHAPE))

    for r in range(max(f.rounds for f in fits)):
        active = [k for k, f in enumerate(fits) if r < f.rounds]
        partial: dict[int, list[tuple[int, int]]] = {k: [] for k in active}
        lighter: dict[int, np.ndarray] = {}
        before: dict[int, np.ndarray] = {}
        for level in range(depth):
            for k, s in sums(active, partial, lighter).items():
                split, won, before[k], lighter[k], halves = grown(s, before.get(k), lighter.get(k), bins[fits[k].group], l2)
                fits[k].gain[split[0]] += won
                partial[k].append(split)
                if level == depth - 1:
                    fits[k].splits.append(partial[k])
                    fits[k].leaves.append(-rate * halves[0] / (halves[1] + l2))
        if r + 1 - kept >= KEPT:
            old, table, kept = table, keep_margins(), r + 1
            old.unpersist()
    table.unpersist()
    return {(f.group, f.out): {"cuts": cuts[f.group], "start": f.start, "splits": np.array(f.splits, np.int64).reshape(-1, depth, 2), "leaves": np.array(f.leaves).reshape(-1, 1 << depth), "gain": f.gain} for f in fits}
