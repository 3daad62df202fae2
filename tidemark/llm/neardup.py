"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vector import LOWER, mix64, slices, words


#: Shingles of a block of texts that a task holds at once.
BLOCK_BYTES = 16 << 20
#: Bytes of texts that are cut to shingles at once.
PART = 1 << 19


@dataclass(frozen=True)
class Settings:
    """Two texts at the similarity agree in a band with probability similarity ** rows; at 0.8 one in 550 pairs shares no band of 12.

    ``idf``: a shingle's weight is its count in the text times 1 + idf * ln((1 + N) / (1 + df)) / ln(1 + N).
    ``small``: buckets up to this many texts give all pairs; larger ones are linked by leaders, what is unlike them is parted by ``further`` bands, and then what is still unlinked meets the whole bucket.
    ``doubt``: pairs whose samples agree in a smaller share aren't verified; a pair at 0.8 falls below half with a probability of about 1e-7.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    idf: float = 0.25
    sketch: int = 1 << 20
    small: int = 16
    further: int = 6
    doubt: float = 0.5


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 32-bit shingle, count) of all texts, sorted. A text of fewer than k words is one shingle; one without words has none."""
    w, start = words(LOWER[data], at)
    n, counts = len(w), np.diff(start)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h[: n - j] += w[j:] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(n) + k <= start[1:][row]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short:  # few words each: what follows a short text must not count
        h[start[i]] = sum(int(x) * pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j, x in enumerate(w[start[i] : start[i + 1]])) & ((1 << 64) - 1)
    whole[start[short]] = True
    key = (row[whole].astype(np.uint64) << np.uint64(32)) | (mix64(h[whole]) >> np.uint64(32))
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), times


def _bucket(h: np.ndarray, s: Settings) -> np.ndarray:
    return (h >> np.uint32(32 - (s.sketch.bit_length() - 1))).astype(np.int64)


def frequencies(docs: DataFrame, s: Settings) -> np.ndarray:
    """The inverse-document-frequency weight of each sketch bucket, from all texts. Its size is fixed by ``sketch``.

    Counts of a bucket's shingles are lowered by the mean load of a bucket, so rare shingles in shared buckets count as rare.
    """
    chunk = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(s.sketch, np.int64), 0
        for whole in batches:
            for _, data, at in slices(whole, "text", PART):
                _, h, _ = shingles(data, at, s.words)
                np.add.at(seen, _bucket(h, s), 1)
                texts += len(at) - 1
        part = TaskContext.get().partitionId() % 64
        blobs = [seen[i : i + chunk].astype("<i8").tobytes() for i in range(0, s.sketch, chunk)]
        m = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([part] * m, pa.int32()), pa.array([texts] * m, pa.int64()), pa.array(blobs)], ["chunk", "part", "texts", "seen"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "<i8") for b in p["seen"])
        return pd.DataFrame({"chunk": p["chunk"][:1], "part": [0], "texts": [p["texts"].sum()], "seen": [total.tobytes()]})

    shape = "chunk int, part int, texts long, seen binary"
    sums = docs.select("text").mapInArrow(count, shape).groupBy("chunk", "part").applyInPandas(add, shape).groupBy("chunk").applyInPandas(add, shape).toPandas()
    if sums.empty:
        return np.ones(s.sketch, np.float32)
    sums = sums.sort_values("chunk")
    n = max(1, int(sums["texts"].max()))
    df = np.concatenate([np.frombuffer(b, "<i8") for b in sums["seen"]]).astype(np.float64)
    df = np.maximum(1, df - df.mean())
    return (1 + s.idf * np.maximum(0, np.log((1 + n) / (1 + df)) / np.log(1 + n))).astype(np.float32)


@lru_cache(1)
def _draws() -> tuple[np.ndarray, ...]:
    """Shared tables of the sampling's random numbers: r and ln c are from Gamma(2, 1), beta is uniform."""
    rng = np.random.default_rng(20240229)
    n = 1 << 16
    r = rng.gamma(2.0, 1.0, n).astype(np.float32)
    return r, (1 / r).astype(np.float32), np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32), rng.random(n, np.float32)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, n: int) -> np.ndarray:
    """[n x texts] consistent weighted samples: a hash of the shingle and level of least ln a. Rows are sorted and every text has one.

    With r, c ~ Gamma(2, 1), beta ~ U(0, 1): t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1).
    """
    r, inverse, log_c, beta = _draws()
    log_w = np.log(weight).astype(np.float32)
    starts = np.searchsorted(row, np.arange(texts))
    out = np.empty((n, texts), np.int32)
    rng = np.random.default_rng(99)
    for k in range(n):
        odd = np.uint32(int(rng.integers(1 << 31)) * 2 + 1)
        i = ((h ^ (h >> np.uint32(15))) * odd) >> np.uint32(16)
        b, rk = beta[i], r[i]
        t = np.floor(log_w * inverse[i] + b)
        log_a = log_c[i] - rk * (t - b + 1)
        key = ((log_a + 100) * 4194304).astype(np.int64) << np.int64(32)  # log_a lies within -100 and 400
        key |= ((h + t.astype(np.int32).astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)).astype(np.int64)
        out[k] = (np.minimum.reduceat(key, starts) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``left`` (written rows) joined with ``right`` (one row for a key) so that no key's rows go to one task.

    Keys with over a thousandth of the rows, at most 1000, are dealt by a hash of ``by`` to 8, 64 or 512 copies of their right row. ``counts`` may give
    (key, n) where they are known.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    each = max(64, left.count() // 1000)
    hot = counts.filter(F.col("n") > each).select(key, "n").collect()  # at most 1000
    salts = F.lit(1)
    for n in (8, 64, 512):
        keys = [r[0] for r in hot if n == min(m for m in (8, 64, 512) if r[1] <= m * each or m == 512)]
        salts = F.when(F.col(key).isin(keys), n).otherwise(salts) if keys else salts
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(7)), salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def _signatures(docs: DataFrame, idf: np.ndarray, s: Settings) -> DataFrame:
    """(node, sample) of texts that have a word."""
    n = s.bands * s.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in slices(whole, "text", PART):
                row, h, times = shingles(data, at, s.words)
                if not len(row):
                    continue
                has, row = np.unique(row, return_inverse=True)
                got = samples(row, h, times * idf[_bucket(h, s)], len(has), n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * n, pa.int32()), pa.array(got.T.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(has)), lists], ["node", "sample"])

    return docs.select("node", "text").mapInArrow(run, "node long, sample array<int>")


def _pairs_of(members: Column) -> Column:
    """All pairs of a short array."""
    n = F.size(members)
    return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice(members, i + 1, n), lambda x: F.struct(F.least(F.element_at(members, i), x).alias("a"), F.greatest(F.element_at(members, i), x).alias("b")))))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs within (key, node) rows whose keys have few nodes."""
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("m")).filter(F.size("m") > 1).select(F.explode(_pairs_of(F.col("m"))).alias("p")).select("p.*")


def _sized(rows: DataFrame) -> DataFrame:
    """Written rows of keys with more than one node, and the key's count."""
    n = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return spread_join(rows, n, "key", "node", n)


def _sets(texts: DataFrame, need: DataFrame, s: Settings) -> DataFrame:
    """(node, h, times) of the needed texts: sorted shingles, and their counts unless all are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in slices(whole, "text", PART):
                row, h, times = shingles(data, at, s.words)
                cut = np.searchsorted(row, np.arange(len(batch) + 1))
                blobs = [h[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:])]
                counts = [times[i:j].astype("<u4").tobytes() if j > i and times[i:j].max() > 1 else b"" for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["node", "h", "times"])

    return written(texts.join(need, "node", "left_semi").mapInArrow(run, "node long, h binary, times binary"))


def _weighted(idf: np.ndarray, s: Settings, h: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles and their weights."""
    x = np.frombuffer(h, "<u4")
    w = idf[_bucket(x, s)].astype(np.float64)
    return x, w * np.frombuffer(times, "<u4") if times else w


def _similarity(x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    both = np.minimum(u[same], v[at[same]]).sum()
    return both / (u.sum() + v.sum() - both)


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, idf: np.ndarray, s: Settings) -> DataFrame:
    """Of (a, b), those whose weighted Jaccard similarity, from their whole texts, is high enough. A text with many partners is dealt to several tasks."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("sample").alias(f"{x}_sample")) for x in "ab")
    agree = F.size(F.filter(F.zip_with("a_sample", "b_sample", lambda x, y: x == y), lambda x: x))
    pairs = written(pairs.distinct())
    likely = spread_join(pairs, a, "a", "b")
    likely = written(spread_join(likely, b, "b", "a", pairs.groupBy("b").agg(F.count("*").alias("n"))).filter(agree >= s.doubt * s.bands * s.rows).select("a", "b"))
    a, b = (sets.select(F.col("node").alias(x), F.col("h").alias(f"{x}_h"), F.col("times").alias(f"{x}_times")) for x in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("a_h", "a_times", "b_h", "b_times")]
            out = np.empty(len(batch))
            for k in range(len(batch)):
                out[k] = _similarity(*_weighted(idf, s, cols[0][k].as_py(), cols[1][k].as_py()), *_weighted(idf, s, cols[2][k].as_py(), cols[3][k].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"])

    both = spread_join(spread_join(likely, a, "a", "b"), b, "b", "a", likely.groupBy("b").agg(F.count("*").alias("n")))
    return written(both.mapInArrow(compare, "a long, b long, similarity double").filter(F.col("similarity") >= s.similarity))


def _led(rows: DataFrame, nth: int = 1) -> DataFrame:
    """Written rows of (key, node, weight) with their key's leader: the text of the largest weight, or (nth 2) of the second largest."""
    first = rows.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    if nth == 2:
        others = spread_join(rows, first, "key", "node").filter("node != leader").drop("leader")
        first = others.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    led = spread_join(rows, first, "key", "node").filter("node != leader")
    return led.withColumn("a", F.least("node", "leader")).withColumn("b", F.greatest("node", "leader"))


def _apart(led: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that aren't linked with their leader."""
    return led.join(edges.select("a", "b"), ["a", "b"], "left_anti").drop("a", "b", "leader")


def _block(rows: DataFrame, n: str, size: int, room: str, name: str) -> DataFrame:
    """Rows with a block of about ``size`` nodes and ``BLOCK_BYTES`` of shingles of their key, by the node's hash; ``n`` counts the key's rows, ``room`` their bytes."""
    count = F.greatest(F.ceil(F.col(n) / size), F.ceil(F.col(room) / BLOCK_BYTES))
    return rows.withColumn(f"{name}s", count.cast("int")).withColumn(name, F.pmod(F.xxhash64(F.lit(name), "node"), f"{name}s").cast("int"))


def _occurrences(idf: np.ndarray, s: Settings, h: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of all texts' elements, and the texts' whole weights: the j-th occurrence of a shingle is an element of its own, so sets do for multisets."""
    x = [np.frombuffer(b, "<u4") for b in h]
    n = [np.frombuffer(t, "<u4") if t else np.ones(len(b), "<u4") for b, t in zip(x, times)]
    text, of = np.repeat(np.arange(len(x)), [len(b) for b in x]), np.concatenate(n).astype(np.int64)
    shingle = np.repeat(np.concatenate(x), of)
    nth = np.arange(len(shingle)) - np.repeat(np.cumsum(of) - of, of)
    text, w = np.repeat(text, of), idf[_bucket(shingle, s)].astype(np.float64)
    return text, shingle.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64), w, np.bincount(text, w, len(x))


def alike(idf: np.ndarray, s: Settings, x: tuple[list[bytes], list[bytes]], y: tuple[list[bytes], list[bytes]], columns: int = 4096) -> np.ndarray:
    """[texts of x, texts of y]: whether their weighted Jaccard similarity, but for rounding, reaches the threshold. Common weights are sums of matrix products, some columns at a time."""
    (tx, ex, wx, ux), (ty, ey, wy, uy) = (_occurrences(idf, s, *side) for side in (x, y))
    shared = np.intersect1d(ex, ey)
    both = np.zeros((len(ux), len(uy)))
    for i in range(0, len(shared), columns):
        part = shared[i : i + columns]
        m = []
        for t, e, w, n in ((tx, ex, wx, len(ux)), (ty, ey, np.ones(len(wy)), len(uy))):
            at = np.minimum(np.searchsorted(part, e), len(part) - 1)
            hit = part[at] == e
            m.append(np.zeros((n, len(part)), np.float32))
            m[-1][t[hit], at[hit]] = w[hit]
        both += m[0] @ m[1].T
    return both >= (s.similarity - 1e-4) * (ux[:, None] + uy - both)


def _across(rows: DataFrame, roots: DataFrame, sets: DataFrame, idf: np.ndarray, s: Settings) -> DataFrame:
    """(a, b): links between the classes of ``roots`` among (key, node) rows with one key, from all pairs of whole texts; of the links that join the same classes one is enough.

    A key's commonest class is left out on one side, so nothing is to do where a key is of one class. A task takes two blocks of a key's nodes, of bounded rows and
    bytes, compares all their pairs at once, and returns the links that its own union-find needs: fewer than its nodes.
    """
    left, right = 128, 1024
    rows = written(rows.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    of = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = of.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("apart")).filter("apart > 0")
    main = written(main)
    if main.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    rows = spread_join(rows, main, "key", "node").join(sets, "node")
    room = F.octet_length("h") + F.octet_length("times") + 8
    rows = written(rows.withColumn("away", F.col("root") != F.col("main")).withColumn("room", room))
    sizes = written(rows.groupBy("key").agg(F.sum("room").alias("all_room"), F.sum(F.when(F.col("away"), F.col("room"))).alias("apart_room")))
    rows = written(_block(_block(spread_join(rows, sizes, "key", "node"), "apart", left, "apart_room", "x"), "all", right, "all_room", "y").drop("main", "room", "all_room", "apart_room", "all", "apart"))

    def blocks(side: DataFrame, own: str, other: str, name: str) -> DataFrame:
        held = side.groupBy("key", own).agg(F.collect_list(F.struct("node", "root", "away", "h", "times")).alias(name), F.first(f"{other}s").alias("count"))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("count") - 1))).drop("count")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (x, u, _, *p), (y, v, away, *q) = ([f.to_pylist() for f in batch.column(c)[k].values.flatten()] for c in ("mx", "my"))
                # Of two nodes that are both away from the key's commonest class, each meets the other: one meeting is enough.
                x, u, y, v, away = (np.array(c) for c in (x, u, y, v, away))
                i, j = np.nonzero(alike(idf, s, p, q) & (u[:, None] != v) & ((x[:, None] < y) | ~away))
                up: dict[int, int] = {}

                def find(r: int) -> int:
                    while up.get(r, r) != r:  # noqa: B023
                        r = up[r]  # noqa: B023
                    return r

                for a, b in zip(i, j):
                    m, n = find(int(u[a])), find(int(v[b]))
                    if m != n and _similarity(*_weighted(idf, s, p[0][a], p[1][a]), *_weighted(idf, s, q[0][b], q[1][b])) >= s.similarity:
                        up[max(m, n)] = min(m, n)
                        yield pa.RecordBatch.from_arrays([pa.array([min(x[a], y[b])]), pa.array([max(x[a], y[b])])], ["a", "b"])

    sides = blocks(rows.filter("away"), "x", "y", "mx"), blocks(rows, "y", "x", "my")
    return written(sides[0].join(sides[1], ["key", "x", "y"]).select("mx", "my").mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the (a, b) edges is linked with, by least neighbours and pointer jumps. Hubs are dealt to several tasks."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degrees = written(both.groupBy("b").agg(F.count("*").alias("n")))
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = spread_join(both, now.withColumnRenamed("node", "b"), "b", "a", degrees).groupBy("a").agg(F.min("root").alias("m")).withColumnRenamed("a", "node")
        step = written(now.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("next")))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("root"))
        new = written(spread_join(step, jump, "next", "node").select("node", "was", "root"))
        if not new.filter("root != was").limit(1).count():
            return new.select("node", "root")
        now = new.select("node", "root")


def _node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _rooted(df: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """(doc_id, node, root): each document's text and its class, both by number. See ``near_duplicates``."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", _node("text"))
    ids = written(docs.select("doc_id", "node"))
    idf = frequencies(docs, s)
    texts = written(docs.select("node", "text").dropDuplicates(["node"]))  # copies are dropped before the shuffle
    nodes = written(_signatures(texts, idf, s))

    band = lambda i: F.xxhash64(F.lit(i), F.slice("sample", i * s.rows + 1, s.rows))
    banded = nodes.select("node", F.array(*[band(i) for i in range(s.bands)]).alias("all")).select("node", F.posexplode("all").alias("i", "key"), "all")
    sized = written(_sized(written(banded)))
    sets = _sets(texts, sized.select("node").distinct(), s)
    weight = sized.groupBy("node").agg(F.sum("n").alias("weight"))
    further = F.posexplode(F.sequence(F.lit(1), F.lit(s.further)))

    def parted(rows: DataFrame) -> DataFrame:
        """Rows of large keys under new keys, each joined with one of the text's next bands; keys with one text go."""
        other = F.element_at("all", F.pmod(F.col("i") + F.col("j"), F.lit(s.bands)).cast("int") + 1)
        new = rows.select("node", "i", "all", "key", further.alias("pos", "j")).select("node", "i", "all", F.xxhash64("key", other).alias("key"))
        return written(_sized(written(new)))

    def few(rows: DataFrame) -> DataFrame:
        return _all_pairs(rows.filter(F.col("n") <= s.small).select("key", "node"))

    def many(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("n") > s.small)

    # Small buckets give all pairs. Texts of large ones are compared with the hub of the largest of them: the text that lies in the most and largest buckets.
    large = written(many(sized).groupBy("node").agg(F.max_by("key", F.struct("n", "key")).alias("key")).join(weight, "node"))
    led = written(_led(large))
    edges = _verified(few(sized).union(led.select("a", "b")), nodes, sets, idf, s)
    # Those that aren't like it are compared with the second such text, and among themselves in the same way.
    apart = written(_apart(led, edges))
    if not apart.isEmpty():
        second = _led(large, 2).join(apart.select("key", "node"), ["key", "node"], "left_semi")
        own = written(_led(apart))
        more = _verified(second.select("a", "b").union(own.select("a", "b")), nodes, sets, idf, s)
        edges = edges.union(more)
        # What is still apart is parted by further bands, in all its large buckets; small parts give all pairs, large ones are led once more.
        still = _apart(own, more).select("node").distinct()
        apart = written(_sized(written(many(sized).drop("n").join(still, "node", "left_semi"))))
        third = parted(many(apart))
        edges = edges.union(_verified(few(apart).union(few(third)).union(_led(written(many(third).drop("n").join(weight, "node"))).select("a", "b")), nodes, sets, idf, s))
    # The exact rest: within a large bucket, texts of different classes meet, whatever they met before.
    roots = components(edges)
    rest = None if large.isEmpty() else _across(many(sized), roots, sets, idf, s)
    if rest is not None and not rest.isEmpty():
        roots = components(edges.select("a", "b").union(rest))
    return written(spread_join(ids, roots, "node", "doc_id", how="left").select("doc_id", "node", F.coalesce("root", "node").alias("root")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, class_size): one row for each document; class_id is the least doc_id of its class.

    Texts are linked when the weighted Jaccard similarity of their TF-IDF weighted five-word shingles is 0.8 or more; classes are the
    components of these links. Equal texts are one node from the start, so copies make no pairs. A bucket of up to ``small`` texts gives all its
    pairs. A text of larger ones is compared with the hub of its largest bucket, the text in the most and
    largest buckets; those unlike it with a second hub and with a hub of their own; the rest are parted by further bands. All pairs of a large bucket
    that are then still in different classes are compared in full. So the classes are those of all pairs within buckets. Work is
    linear in a bucket's size for texts that the hubs link, and grows with the square for texts that nothing links.

    Null texts are empty. Texts without words are only like equal texts. Repeated ids, null ids and repeated rows each get a
    row; a class without any id has a null class_id. No rows: no rows.
    """
    known = _rooted(df, doc_id, text, settings)
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return spread_join(known, least, "root", "doc_id", least.select("root", F.col("class_size").alias("n"))).select("doc_id", "class_id", "class_size")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of one document of each class, with all their columns, whatever their names: that of least id (null last); of repeated rows, the first by a hash of all columns."""
    known = _rooted(df, doc_id, text, settings)
    first = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f")).select(F.col("f.doc_id").alias("kept_id"), F.col("f.node").alias("kept_node"))
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).alias("id"), _node(text).alias("node"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["kept_id"]) & (rows["node"] == first["kept_node"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "node").orderBy(F.xxhash64("row")))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")
