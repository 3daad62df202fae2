"""Numpy helpers on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.common import utf8

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``most`` bytes of text each (a longer text is a part of its own), with bytes and offsets."""
    data, at = utf8(batch.column(column))
    row, n = 0, len(batch)
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, upto - row), data[at[row] : at[upto]], at[row : upto + 1] - at[row]
        row = upto


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = 1 << int(n - 1).bit_length()
        ups = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64))) for b in (BASE, BASE_INVERSE)]
        if n > 1 << 23:
            return ups[0], ups[1]  # for one very long text; not kept
        _powers = ups[0], ups[1]
    return _powers


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than ASCII white space), and the offsets of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    letter = ~SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | begins[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start]), np.searchsorted(start, at)


class Hot:
    """An open-addressing table from 64-bit keys to values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.used = np.zeros(1 << bits, bool)
        self.values = np.zeros(1 << bits, values.dtype)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[slot[left]]]
            place, one = np.unique(slot[free], return_index=True)
            self.used[place], self.keys[place], self.values[place] = True, keys[free[one]], values[free[one]]
            left = np.setdiff1d(left, free[one], assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * BASE) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether there is one."""
        slot = self._slot(keys)
        found = self.used[slot] & (self.keys[slot] == keys)
        out = np.where(found, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~found & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            used = self.used[slot[left]]
            hit = used & (self.keys[slot[left]] == keys[left])
            found[left[hit]] = True
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[used & ~hit]
        return out, found
