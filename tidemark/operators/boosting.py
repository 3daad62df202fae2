"""Gradient-boosted symmetric trees on binned features: fitted for each group of rows in one task, and applied to all rows."""

from __future__ import annotations

import numpy as np

BINS = 64
#: Rows whose sums are added up together.
CHUNK = 4096


def edges(x: np.ndarray) -> list[np.ndarray]:
    """Bin edges of each column: distinct quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in np.nan_to_num(x).T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins by (row, feature); those of a feature lie side by side."""
    return np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for e, c in zip(cuts, np.nan_to_num(x).T)]).T


def nodes(split: list[tuple[int, int]], b: np.ndarray) -> np.ndarray:
    """The node that each row comes to by a tree's splits; ``b`` are bins by (feature, row)."""
    node = np.zeros(b.shape[1], np.uint8 if len(split) <= 8 else np.int64)
    for j, at in split:
        node = node * 2 + (b[j] > at)
    return node


def sums(b: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, bins: list[int], many: int, own: np.ndarray | None = None) -> np.ndarray:
    """[2, nodes, bins of all features]: sums of gradients and Hessians. ``own`` are the rows in ``b`` that the other arrays are of (None: all)."""
    width = sum(bins)
    first = np.concatenate(([0], np.cumsum(bins)[:-1]))[:, None]
    out = np.zeros((2, many * width))
    for i in range(0, len(node), CHUNK):
        part = slice(i, i + CHUNK)
        cell = (b[:, part] if own is None else b[:, own[part]]) + first
        cell += node[part].astype(np.int64) * width
        for s, v in zip(out, (g, h)):
            s += np.bincount(cell.ravel(), np.tile(v[part], len(bins)), many * width)
    return out.reshape(2, many, width)


def grown(s: np.ndarray, before: np.ndarray | None, lighter: np.ndarray | None, bins: list[int], l2: float) -> tuple[tuple[int, int], float, np.ndarray, np.ndarray, np.ndarray]:
    """A level's (feature, bin) of most gain, that gain, the level's sums, which half of each node is the lighter (1: the right one), and [2, halves]: gradients and Hessians of the nodes' halves.

    ``s`` are the sums over the lighter half of each node of the level before, whose sums are ``before``: the other half is the rest. At the root, ``s`` are those of all rows. Splits whose gains differ by
    rounding only count as equal and the first is taken, so the order in which rows are added up doesn't matter.
    """
    if before is not None:
        both = np.stack((before - s, s), axis=2)
        both[:, lighter == 0] = both[:, lighter == 0, ::-1]
        s = both.reshape(2, -1, s.shape[2])
    ends = np.cumsum(bins)
    upto = s.cumsum(axis=2)
    left = upto - np.repeat(np.concatenate((np.zeros((*s.shape[:2], 1)), upto[:, :, ends[:-1] - 1]), axis=2), bins, axis=2)
    right = left[:, :, ends[0] - 1, None] - left
    value = (left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2)).sum(axis=0)
    most = int(np.argmax(value >= value.max() * (1 - 1e-9)))
    j = int(np.searchsorted(ends, most, "right"))
    halves = np.stack((left[:, :, most], right[:, :, most]), axis=2).reshape(2, -1)
    return (j, most - int(ends[j]) + bins[j]), max(0.0, float(value[most] - value[ends - 1].max())), s, (right[1, :, most] < left[1, :, most]).astype(np.uint8), halves


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float = 0.05, l2: float = 3.0) -> dict:
    """Newton boosting of the logistic loss. All nodes of a level split alike, by the (feature, bin) of most gain; a tree is ``depth`` splits and its leaves.

    Unknown values count as 0. ``gain`` sums each feature's gains.
    """
    cuts = edges(x)
    b, (n, f) = np.ascontiguousarray(binned(x, cuts).T), x.shape
    bins = [len(c) + 1 for c in cuts]
    mean = np.average(y, weights=weight)
    start = float(np.log(mean / (1 - mean)))
    score, gain = np.full(n, start), np.zeros(f)
    splits, leaves = np.zeros((rounds, depth, 2), np.int64), np.zeros((rounds, 1 << depth))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.uint8 if depth <= 8 else np.int64)
        s = lighter = None
        for level in range(depth):
            if s is None:
                got = sums(b, node, g, h, bins, 1)
            else:
                own = np.flatnonzero((node & 1) == lighter[node >> 1])
                got = sums(b, node[own] >> 1, g[own], h[own], bins, len(lighter), own)
            (j, at), won, s, lighter, halves = grown(got, s, lighter, bins, l2)
            gain[j] += won
            splits[r, level] = j, at
            node = node * 2 + (b[j] > at)
        leaves[r] = -rate * halves[0] / (halves[1] + l2)
        score += leaves[r][node]
    return {"cuts": cuts, "start": start, "splits": splits, "leaves": leaves, "gain": gain}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of class 1."""
    b = binned(x, model["cuts"]).T
    score = np.full(len(x), model["start"])
    for split, leaf in zip(model["splits"], model["leaves"]):
        score += leaf[nodes(split, b)]
    return 1 / (1 + np.exp(-score))


def quality(y: np.ndarray, p: np.ndarray) -> tuple[float, float, float]:
    """(auc, average precision, Brier score); 0.5 and 0 with one class."""
    brier = float(((p - y) ** 2).mean()) if len(y) else float("nan")
    pos = int(y.sum())
    if not 0 < pos < len(y):
        return 0.5, 0.0, brier
    values, which, n = np.unique(p, return_inverse=True, return_counts=True)
    hit = np.bincount(which, y)
    below = np.cumsum(n) - n
    auc = ((hit * (below + (n + 1) / 2)).sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))
    tp, seen = np.cumsum(hit[::-1]), np.cumsum(n[::-1])
    return float(auc), float((hit[::-1] * tp / seen).sum() / pos), brier
