"""Language-model scores: context-tree weighting over bytes, and a word unigram as a base.

Every byte is eight binary decisions. Each decision has a context tree of its own over the preceding bytes, down to four of them,
with a Krichevsky-Trofimov estimator at each node. A node's weighted probability is half its own estimate's block probability and
half the product of its children's; going up a path, the same weights mix the estimates of all depths into one prediction.
The counts come from the training texts only, so the model is fixed while it scores, and a text's order of bytes gives
its probability as a sum over (context, byte) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vector import LOWER, Hot, mix64, slices, words

DEPTH = 4
#: The byte that ends a text; UTF-8 has none like it.
END = 255
#: Pairs and words that each task gets as a table; rarer ones are joined.
HOT = 1 << 18
#: Distinct keys that a task gathers before it sends them on.
GATHERED = 500_000
#: Pairs dealt to one group that evaluates context trees, about; a two-byte context with more is evaluated by its third byte.
GROUP_PAIRS = 50_000
#: Bytes of text that are worked on at once.
PART = 1 << 20
GRAM, WORD = 0, 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up; x is above 0."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _weights(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted log probability of nodes, and the share that their own estimate has in a prediction."""
    return np.logaddexp(kt, below) - np.log(2.0), 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))


def pairs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (context, byte) pair as a number of five bytes, the byte last, and where each text begins; zeros stand before a text, ``END`` after it."""
    n, texts = len(data), len(at) - 1
    gap = DEPTH + 1
    padded = np.zeros(n + gap * texts, np.uint8)
    shift = np.repeat(np.arange(texts), np.diff(at)) * gap + DEPTH
    padded[np.arange(n) + shift] = data
    padded[at[1:] + np.arange(texts) * gap + DEPTH] = END
    key = np.zeros(len(padded) - DEPTH, np.uint64)
    for j in range(DEPTH + 1):
        key = (key << np.uint64(8)) | padded[j : j + len(key)]
    own = np.ones(len(padded), bool)
    own[(at[:-1] + np.arange(texts) * gap)[:, None] + np.arange(DEPTH)[None, :]] = False
    return key[own[DEPTH:]], at[:-1] + np.arange(texts)


class _Counter:
    """Sums by key over arrays, emptied when it has gathered many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, train: np.ndarray, seen: np.ndarray) -> None:
        self.parts.append((keys, train, seen))
        self.rows += len(keys)
        if self.rows > GATHERED:
            self.parts = [self.sums()]
            self.rows = len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return keys, *(np.bincount(where, np.concatenate([p[i] for p in self.parts]), len(keys)).astype(np.int64) for i in (1, 2))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gathered = _Counter(), _Counter()

    def out() -> Iterator[pa.RecordBatch]:
        for kind, counter in enumerate(gathered):
            keys, train, seen = counter.sums()
            counter.parts, counter.rows = [], 0
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                k = keys[part].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(train[part]), pa.array(seen[part])], ["kind", "key", "train", "seen"])

    for whole in batches:
        for batch, data, at in slices(whole, "text", PART):
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            data = LOWER[data]
            for kind, (keys, starts) in enumerate((pairs(data, at), words(data, at))):
                if kind == WORD:
                    starts = starts[:-1]
                lengths = np.diff(np.append(starts, len(keys)))
                learn = np.repeat(~held, lengths)
                for chosen, trains in ((learn, 1), (~learn, 0)):
                    if kind == WORD and not trains:
                        continue
                    u, n = np.unique(keys[chosen], return_counts=True)
                    gathered[kind].add(u, n * trains, n)
            if any(c.rows > GATHERED for c in gathered):
                yield from out()
    yield from out()


def _tree(key: np.ndarray) -> np.ndarray:
    """[8 x pairs]: the nodes, by number within a context, at which the eight bits of each pair's byte are decided."""
    sym = key & np.uint64(255)
    return np.stack([(np.uint64(1) << np.uint64(j)) | (sym >> np.uint64(8 - j)) for j in range(8)])


def _nodes(key: np.ndarray, n: np.ndarray, last: int = 2):
    """For depths from the deepest to ``last``: each pair's eight nodes, the nodes' counts, weights and own shares.

    Yields (depth, node numbers, nodes of the pairs [8 x pairs], zeros, ones, weighted log probability, share).
    """
    sym, context = key & np.uint64(255), key >> np.uint64(8)
    tree = _tree(key)
    bit = np.stack([((sym >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64) for j in range(8)])
    child_ids, child_log = None, None
    for depth in range(DEPTH, last - 1, -1):
        mask = np.uint64((1 << (8 * depth)) - 1)
        ids = ((context & mask)[None, :] << np.uint64(8)) | tree
        nodes, where = np.unique(ids.ravel(), return_inverse=True)
        where = where.reshape(ids.shape)
        many = np.broadcast_to(n, ids.shape)
        n1 = np.bincount(where.ravel(), (many * bit).ravel(), len(nodes))
        n0 = np.bincount(where.ravel(), (many * (1 - bit)).ravel(), len(nodes))
        kt = log_kt(n0, n1)
        if child_ids is None:
            log, share = kt, np.ones(len(nodes))
        else:
            parent = (((child_ids >> np.uint64(8)) & mask) << np.uint64(8)) | (child_ids & np.uint64(255))
            below = np.bincount(np.searchsorted(nodes, parent), child_log, len(nodes))
            log, share = _weights(kt, below)
        yield depth, nodes, where, bit, n0, n1, log, share
        child_ids, child_log = nodes, log


def _given_up(p: pd.DataFrame, depth: int) -> pd.DataFrame:
    """What the trees' nodes of ``depth`` give to the depth above: counts and log probabilities by (context bytes there, node)."""
    *_, (_, nodes, _, _, n0, n1, log, _) = _nodes(p["key"].to_numpy().view(np.uint64), p["train"].to_numpy(), depth)
    above = np.uint64((1 << (8 * (depth - 1))) - 1)
    top, where = np.unique(((nodes >> np.uint64(8)) & above) << np.uint64(8) | (nodes & np.uint64(255)), return_inverse=True)
    return pd.DataFrame({"top": top.astype(np.int64), "n0": np.bincount(where, n0), "n1": np.bincount(where, n1), "log": np.bincount(where, log)})


def _tops(p: pd.DataFrame) -> pd.DataFrame:
    return _given_up(p, 2)


def _thirds(p: pd.DataFrame) -> pd.DataFrame:
    return _given_up(p, 3)


def _weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depth-2 nodes from what depth 3 gives them: their own share, their estimate of a one, and their weighted log probability."""
    for p in batches:
        n0, n1 = p["n0"].to_numpy(), p["n1"].to_numpy()
        log, share = _weights(log_kt(n0, n1), p["log"].to_numpy())
        yield pd.DataFrame({"top": p["top"], "n0": n0, "n1": n1, "log": log, "share": share, "one": (n1 + 0.5) / (n0 + n1 + 1)})


def _upper(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own share and estimate of a one, for the nodes of depth 1 by (last byte, node) and of depth 0 by node."""
    n0, n1, below = np.zeros(65536), np.zeros(65536), np.zeros(65536)
    n0[t["top"]], n1[t["top"]], below[t["top"]] = t["n0"], t["n1"], t["log"]
    log, share1 = _weights(log_kt(n0, n1), below)
    by_node = lambda x: x.reshape(256, 256).sum(axis=0)
    _, share0 = _weights(log_kt(by_node(n0), by_node(n1)), by_node(np.where(n0 + n1 > 0, log, 0)))
    return share1, (n1 + 0.5) / (n0 + n1 + 1), share0, (by_node(n1) + 0.5) / (by_node(n0) + by_node(n1) + 1)


def _pair_scores(key: np.ndarray, n: np.ndarray, upper, middle: pd.DataFrame | None = None) -> np.ndarray:
    """log10 of the mixed probability of each pair's byte in its context. ``middle`` has the nodes of depth 2 where the pairs at hand aren't all of their two-byte contexts."""
    one = None
    for _, _, where, bit, n0, n1, _, share in _nodes(key, n, 2 if middle is None else 3):
        own = ((n1 + 0.5) / (n0 + n1 + 1))[where]
        s = share[where]
        one = own if one is None else s * own + (1 - s) * one
        bits, at = bit, where
    tree = _tree(key).astype(np.int64)
    if middle is not None:
        m = middle.sort_values("top")
        at = np.searchsorted(m["top"].to_numpy(), (((key >> np.uint64(8)) & np.uint64(65535)).astype(np.int64) << 8)[None, :] | tree)
        s = m["share"].to_numpy()[at]
        one = s * m["one"].to_numpy()[at] + (1 - s) * one
    share1, kt1, share0, kt0 = upper
    last = (key >> np.uint64(8)) & np.uint64(255)
    top = (last.astype(np.int64) << 8)[None, :] | tree
    one = share1[top] * kt1[top] + (1 - share1[top]) * one
    one = share0[tree] * kt0[tree] + (1 - share0[tree]) * one
    return np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=0)


def _hot(counts: DataFrame, value: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys and values of the at most ``HOT`` most frequent rows, by a histogram of powers, and the least count among them."""
    level = F.floor(F.log2("seen") * 8).cast("int")
    steps = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # at most 512 rows
    room, least = HOT, None
    for step, n in steps:
        if n > room:
            break
        room, least = room - n, step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.float64), np.inf
    got = counts.filter(level >= least).select("key", value.alias("value")).toArrow()
    return got["key"].to_numpy().view(np.uint64), got["value"].to_numpy().astype(np.float64), least


def score(df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    Texts that are not held out are learned from. Tokens of the base are words of lower-cased text and one end of each text, with add-one smoothing. ``score``
    is the context trees' log10 probability of the text's lower-cased bytes and its end. Null texts are empty. Every row is
    scored, repeated rows too. No rows: no rows.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = written(docs.select("held_out", "text").mapInArrow(_count, "kind int, key long, train long, seen long").groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("seen").alias("seen")))
    grams, vocabulary = counts.filter(f"kind = {GRAM}"), counts.filter(f"kind = {WORD}")

    ends = docs.agg(F.count_if(~F.col("held_out"))).first()[0]  # each training text has one end token
    n_words, v_words = vocabulary.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count("*")).first()
    n, v = n_words + ends, v_words + (ends > 0)

    # Trees are cut by their last two bytes, so all nodes from depth 2 on lie in one group. Two-byte contexts of too many pairs are cut by their last three bytes (65,536 pairs at most), and their
    # nodes of depth 2 are summed up over these.
    groups = max(1, grams.count() // GROUP_PAIRS)
    of = lambda n: F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * n)) - 1))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    hot = [r[0] for r in grams.groupBy(of(2).alias("two")).count().filter(F.col("count") > GROUP_PAIRS).collect()]  # at most 65,536, and one for each so many pairs
    is_hot = of(2).isin(hot) if hot else F.lit(False)
    dealt = grams.filter(~is_hot).select("key", "train", group(of(2)).alias("group"))
    sums = "top long, n0 double, n1 double, log double"
    tops = dealt.groupBy("group").applyInPandas(_tops, sums)
    if hot:
        parted = grams.filter(is_hot).select("key", "train", group(of(3)).alias("group"))
        thirds = parted.groupBy("group").applyInPandas(_thirds, sums).groupBy("top").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log")])
        middle = written(thirds.mapInPandas(_weighed, sums + ", share double, one double"))  # 255 rows at most for each hot context
        last = F.shiftright("top", 8).bitwiseAND(F.lit(255)) * 256 + F.col("top").bitwiseAND(F.lit(255))
        tops = tops.unionByName(middle.select(last.alias("top"), "n0", "n1", "log"))
    upper = _upper(tops.groupBy("top").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("log")).orderBy("top").toPandas())  # at most 65,536 rows

    def evaluate(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": p["key"], "value": _pair_scores(p["key"].to_numpy().view(np.uint64), p["train"].to_numpy(), upper)})

    values = dealt.groupBy("group").applyInPandas(evaluate, "key long, value double")
    if hot:

        def evaluate_parts(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            if p.empty:
                return pd.DataFrame({"key": np.zeros(0, np.int64), "value": np.zeros(0)})
            return pd.DataFrame({"key": p["key"], "value": _pair_scores(p["key"].to_numpy().view(np.uint64), p["train"].to_numpy(), upper, m)})

        third = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.pmod(F.xxhash64(b.cast("long") * 65536 + F.shiftright("top", 8)), F.lit(groups)))
        sent = middle.select("top", "share", "one", F.explode(F.array_distinct(third)).alias("group"))
        values = values.unionByName(parted.groupBy("group").cogroup(sent.groupBy("group")).applyInPandas(evaluate_parts, "key long, value double"))
    values = written(values.join(grams.select("key", "seen"), "key"))
    gram_keys, gram_values, gram_least = _hot(values, F.col("value"))
    word_keys, word_values, word_least = _hot(vocabulary, F.col("train"))
    gram_hot, word_hot = (gram_keys, gram_values), (word_keys, word_values)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, word_table = Hot(*gram_hot), Hot(*word_hot)
        for whole in batches:
            for batch, data, at in slices(whole, "text", PART):
                data = LOWER[data]
                keys, starts = pairs(data, at)
                value, found = gram_table.get(keys)
                cols = [np.add.reduceat(value, starts)]
                cold = [_cold(keys, ~found, starts)]
                keys, where = words(data, at)
                value, found = word_table.get(keys)
                log = np.concatenate(([0.0], np.cumsum(np.where(found, np.log10(value + 1), 0.0))))
                cols.append(log[where[1:]] - log[where[:-1]])
                known = np.concatenate(([0], np.cumsum(found)))
                cols += [known[where[1:]] - known[where[:-1]], np.diff(where), np.diff(at)]
                cold.append(_cold(keys, ~found, where[:-1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, cols), *cold], names)

    names = ["doc_id", "held_out", "gram_score", "word_score", "known", "n_words", "n_bytes", "cold_grams", "cold_words"]
    shape = f"doc_id {id_type}, held_out boolean, gram_score double, word_score double, known long, n_words long, n_bytes long, cold_grams array<long>, cold_words array<long>"
    part = written(docs.mapInArrow(first_pass, shape).withColumn("rid", F.monotonically_increasing_id()))

    # The rare pairs and words of each text are joined with their values.
    def rare(column: str, kind: int) -> DataFrame:
        return part.select("rid", F.explode(column).alias("key")).groupBy("rid", "key").agg(F.count("*").alias("times")).withColumn("kind", F.lit(kind))

    level = F.floor(F.log2("seen") * 8).cast("int")
    cold_values = values.filter(level < F.lit(gram_least)).select(F.lit(GRAM).alias("kind"), "key", "value").unionByName(vocabulary.filter(level < F.lit(word_least)).select("kind", "key", F.col("train").cast("double").alias("value")))
    cold = rare("cold_grams", GRAM).unionByName(rare("cold_words", WORD)).join(cold_values, ["kind", "key"])
    word = F.col("kind") == WORD
    cold = cold.groupBy("rid").agg(
        F.sum(F.when(word, 0.0).otherwise(F.col("value") * F.col("times"))).alias("cold_score"),
        F.sum(F.when(word, F.log10(F.col("value") + 1) * F.col("times")).otherwise(0.0)).alias("cold_word_score"),
        F.sum(F.when(word, F.col("times")).otherwise(0)).alias("cold_known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = part.drop("cold_grams", "cold_words").join(cold, "rid", "left")
    tokens = F.col("n_words") + 1
    total = F.col("gram_score") + zero("cold_score")
    return all_.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("known") + zero("cold_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("word_score") + zero("cold_word_score") + F.log10(F.lit(ends + 1.0)) - tokens * F.log10(F.lit(n + v + 1.0))).alias("base_score"),
        total.alias("score"),
        (-total * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _cold(keys: np.ndarray, left: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A list for each text: its keys that ``left`` marks."""
    before = np.concatenate(([0], np.cumsum(left)))
    offsets = before[np.append(starts, len(keys))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[left].view(np.int64)))
