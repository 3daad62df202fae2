"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties in parallel shards whose weights are averaged, then
calibrated by one temperature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import refuse
from tidemark.llm.vector import mix64

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample``: training documents of one language, as expected by a hash of the id; all statistics use all of them."""

    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    sample: int = 2000
    shards: int = 8
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2e-3
    l2: float = 1e-3
    scale: float = 20.0


@dataclass(frozen=True)
class Model:
    """weights: languages x buckets, times the inverse document frequency. Its size is languages x buckets x 4 bytes."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings


def _grams(bodies: list[str], s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each character of the joined texts; and where each text begins.

    Two line feeds stand after each text; n-grams of up to three characters that begin at them are those of the last text, which nothing follows, so no text meets the next one.
    """
    joined = "\n\n".join(bodies) + "\n\n"
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum([len(b) + 2 for b in bodies])))[:-1]
    out, key = [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(s.orders) + 1):
        key[: len(chars) - n + 1] = key[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in s.orders:
            g = (mix64(key + np.uint64(n)) & np.uint64(s.buckets - 1)).astype(np.int32)
            g[at[1:] - 2], g[at[1:] - 1] = g[-2], g[-1]
            out.append(g)
    return out, at


def _parts(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Lower-case texts of a batch's last column in parts of about ``most`` characters and at most 512 rows."""
    column = batch.column(batch.num_columns - 1)
    for first in range(0, len(column), 512):
        bodies = [(t or "").lower() for t in column.slice(first, 512).to_pylist()]
        row = 0
        while row < len(bodies):
            upto, n = row, 0
            while upto < len(bodies) and (upto == row or n + len(bodies[upto]) <= most):
                n += len(bodies[upto])
                upto += 1
            yield first + row, bodies[row:upto]
            row = upto


def _features(body: str, s: Settings, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, _ = _grams([body], s)
    counts = np.bincount(np.concatenate(grams), minlength=s.buckets)
    j = np.flatnonzero(counts)
    return j, counts[j] * idf[j] * (s.scale / (len(body) + 2))


def _scores(bodies: list[str], m: Model) -> np.ndarray:
    grams, at = _grams(bodies, m.settings)
    lengths = np.array([len(b) + 2 for b in bodies])
    out = np.empty((len(bodies), len(m.languages)))
    for c in range(len(m.languages)):
        w = m.weights[c]
        per_char = w[grams[0]]
        for g in grams[1:]:
            per_char = per_char + w[g]
        out[:, c] = np.add.reduceat(per_char, at, dtype=np.float64) * (m.settings.scale / lengths) + m.bias[c]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(bodies: list[str], y: np.ndarray, languages: int, s: Settings, idf: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x languages) and biases after some epochs of FTRL-proximal."""
    z, n = np.zeros((s.buckets + 1, languages)), np.zeros((s.buckets + 1, languages))  # the last row is the bias, without penalty
    l1 = np.full((s.buckets + 1, 1), s.l1)
    l1[-1] = 0

    def weights(j: np.ndarray) -> np.ndarray:
        zj = z[j]
        return np.where(np.abs(zj) <= l1[j], 0.0, -(zj - np.sign(zj) * l1[j]) / ((s.beta + np.sqrt(n[j])) / s.alpha + s.l2))

    rng = np.random.default_rng(seed)
    ready = [_features(b, s, idf) for b in bodies]
    for _ in range(s.epochs):
        for i in rng.permutation(len(bodies)):
            j, x = ready[i]
            j, x = np.append(j, s.buckets), np.append(x, 1.0)
            w = weights(j)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / s.alpha
            z[j] += g - sigma * w
            n[j] += g * g
    w = weights(np.arange(s.buckets + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / math.exp(t))[np.arange(len(y)), y]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    a, b, r = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", settings: Settings = Settings()) -> Model | None:
    """A model from the rows with a language; None where there is none. Null texts are left out.

    Document frequencies come from all rows. The classifier is fitted on at most about ``sample`` documents of each
    language, drawn by a hash of id and text; a fifth of these only set the temperature.
    """
    s = settings
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    languages = tuple(sorted(counts))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for _, bodies in _parts(batch):
                grams, at = _grams(bodies, s)
                ends = np.append(at[1:], len(grams[0]))
                for a, b in zip(at, ends):
                    flags = np.zeros(s.buckets, bool)
                    for g in grams:
                        flags[g[a:b]] = True
                    seen += flags
        j = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(seen[j])], ["bucket", "docs"])

    df_rows = rows.select("text").mapInArrow(frequencies, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()  # at most one row a bucket
    idf = np.ones(s.buckets)
    total = sum(counts.values())
    idf[df_rows["bucket"]] += np.log((1 + total) / (1 + df_rows["docs"].to_numpy()))

    draw = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, s.sample / n) * (1 << 30)))]), F.col("lang"))
    number = F.array_position(F.lit(list(languages)), F.col("lang")).cast("int") - 1
    sample = rows.filter(draw < limit).select("text", number.alias("y"), F.pmod(F.xxhash64("text", "id", F.lit(13)), F.lit(5 * s.shards)).alias("part"))
    n_lang = len(languages)

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["text", "y"], ignore_index=True)
        w, bias = _ftrl([t.lower() for t in p["text"]], p["y"].to_numpy(), n_lang, s, idf, 7)
        w = np.vstack((w, bias))
        j, c = np.nonzero(w)
        return pd.DataFrame({"bucket": j, "y": c, "weight": w[j, c]})

    fitted = sample.filter(F.col("part") >= s.shards).withColumn("shard", F.pmod("part", F.lit(s.shards))).groupBy("shard").applyInPandas(fit, "bucket int, y int, weight double")
    shards = min(s.shards, max(1, total))
    sums = fitted.groupBy("bucket", "y").agg(F.sum("weight").alias("weight")).toPandas()  # at most buckets x languages
    w = np.zeros((s.buckets + 1, n_lang))
    w[sums["bucket"], sums["y"]] = sums["weight"].to_numpy() / shards
    model = Model(languages, np.ascontiguousarray((w[:-1] * idf[:, None]).T.astype(np.float32)), w[-1], 1.0, s)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bodies in _parts(batch):
                got = _scores(bodies, model)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(row, len(bodies)), pa.array(list(got), pa.list_(pa.float64()))], ["y", "logits"])

    held = sample.filter(F.col("part") < s.shards).select("y", "text").mapInArrow(logits, "y int, logits array<double>").toPandas()  # part of the bounded sample
    held = held.sort_values("y", kind="stable")
    t = _temperature(np.array(held["logits"].tolist()).reshape(-1, n_lang), held["y"].to_numpy())
    return Model(model.languages, model.weights, model.bias, t, s)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and (lang_pred, score): the likeliest language and its calibrated probability, of whole texts.

    ``und`` with score 0 where the text is null or has no letter, or there is no model.
    Of equally likely languages the first by code point is told. Repeated rows and ids each get a row; no rows: no rows. A kept column with the name of a result is an error.
    """
    refuse(keep, ("lang_pred", "score", "lang_pred_of"))
    if model is None:
        return df.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kept = df.select(*keep, F.col(text).alias("lang_pred_of"))

    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bodies in _parts(batch):
                p = _softmax(_scores(bodies, model) / model.temperature)
                best = p.argmax(axis=1)
                letter = np.array([any(map(str.isalpha, b)) for b in bodies], bool)
                part = batch.slice(row, len(bodies))
                cols = part.columns[:-1]
                pred = pa.array(np.where(letter, names[best], UNKNOWN).tolist(), pa.string())
                score = pa.array(np.where(letter, p[np.arange(len(best)), best], 0.0))
                yield pa.RecordBatch.from_arrays([*cols, pred, score], [*keep, "lang_pred", "score"])

    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
