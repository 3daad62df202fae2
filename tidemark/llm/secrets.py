"""Secret scans: fixed patterns, and a randomness test battery over tokens with false-discovery control of what is reported."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import written
from tidemark.llm.vector import mix64, slices

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 12}


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UP, _LOW, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
HEX, ACCESS, TOKEN = _class(_DIGIT + "abcdef"), _class(_UP + _DIGIT), _class(_UP + _LOW + _DIGIT + "+/_-")
#: Letters from common to rare (as in English): blocks of this order tell words from random draws best.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"
#: Encodings a token may have, narrowest first: the first whose alphabet holds all its symbols is inferred.
ALPHABETS = {
    "hex": _DIGIT + "abcdef", "hex_upper": _DIGIT + "ABCDEF", "lower": _COMMON, "upper": _COMMON.upper(), "base32": _COMMON.upper() + "234567", "base36": _COMMON + _DIGIT,
    "letters": _COMMON + _COMMON.upper(), "base62": _COMMON + _COMMON.upper() + _DIGIT, "base64": _COMMON + _COMMON.upper() + _DIGIT + "+/", "base64_url": _COMMON + _COMMON.upper() + _DIGIT + "-_",
}
_NAMES, _SIZES = list(ALPHABETS), np.array([len(a) for a in ALPHABETS.values()])
_INDEX = np.full((len(ALPHABETS), 256), -1, np.int16)
for _i, _a in enumerate(ALPHABETS.values()):
    _INDEX[_i, list(_a.encode())] = np.arange(len(_a))
#: For each byte, the alphabets that hold it, as bits.
_HOLDS = ((_INDEX >= 0) << np.arange(len(ALPHABETS))[:, None]).sum(0).astype(np.int32)
#: Length classes: tests on longer tokens have more power, so each class controls its own false discoveries.
LENGTHS = (12, 16, 20, 28, 40, 64)
#: p-values are counted in steps of a twentieth of a power of ten. From ``LOST`` on a token is no candidate: draws at random come there once in 100,000.
STEP, LOST = 0.05, 100

#: Bytes of texts that are scanned at once.
PART = 1 << 20

SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("group", pa.int32()), ("bin", pa.int32())])
COUNT = pa.struct([("group", pa.int32()), ("bin", pa.int32()), ("tokens", pa.int64()), ("ordinary", pa.int64())])


def _runs(member: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least`` members; none crosses a text's beginning."""
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1] | begins[1:]
    last[:-1] &= ~member[1:] | begins[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = e - s >= least
    return s[long], e[long]


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _upper_normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2)).astype(np.float64)


def battery(symbols: np.ndarray, first: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Fisher's combined p-value under "drawn at random" for each token: ``symbols`` holds all tokens' places in their alphabets of ``k``, token i's from ``first[i]`` on.

    Three tests: chi-squared of the alphabet's uniformity, in as many blocks of the alphabet as five symbols each allow (upper tail, Wilson and Hilferty); Wald and
    Wolfowitz's runs above and below the alphabet's middle; and the correlation of neighbours against the alphabet's mean and variance (both two-sided).
    """
    if not len(n):
        return np.zeros(0)
    x, of = symbols.astype(np.int64), np.repeat(np.arange(len(n)), n)
    blocks = np.maximum(2, np.minimum(k, n // 5))
    base = np.concatenate(([0], np.cumsum(blocks)))
    seen = np.bincount(base[of] + x * blocks[of] // k[of], minlength=base[-1]).astype(np.float64)
    block = np.arange(base[-1]) - np.repeat(base[:-1], blocks)
    b, a = np.repeat(blocks, blocks), np.repeat(k, blocks)
    expected = (-(-(block + 1) * a // b) - -(-block * a // b)) * np.repeat(n / k, blocks)
    df = blocks - 1.0
    stat = np.add.reduceat((seen - expected) ** 2 / expected, base[:-1]) / df
    chi = _upper_normal((np.cbrt(stat) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))

    high = x >= k[of] / 2
    n1 = np.add.reduceat(high.astype(np.int64), first)
    n0 = n - n1
    inside = np.ones(len(x), bool)
    inside[first] = False
    turns = np.zeros(len(x), np.int64)
    turns[1:] = high[1:] != high[:-1]
    runs = 1 + np.add.reduceat(turns * inside, first)
    both = 2.0 * n1 * n0
    spread = np.sqrt(np.maximum(both * (both - n) / (n * n * (n - 1.0)), 1e-9))
    one_sided = (n1 == 0) | (n0 == 0)
    run = np.where(one_sided, 2.0 ** (1 - np.minimum(n, 1000.0)), np.minimum(1, 2 * _upper_normal(np.abs(runs - 1 - both / n) / spread)))

    y = x - (k[of] - 1) / 2
    product = np.zeros(len(x))
    product[1:] = y[1:] * y[:-1]
    z = np.add.reduceat(product * inside, first) / ((k * k - 1) / 12 * np.sqrt(n - 1.0))
    serial = np.minimum(1, 2 * _upper_normal(np.abs(z)))
    half = -(np.log(np.maximum(chi, 1e-300)) + np.log(np.maximum(run, 1e-300)) + np.log(np.maximum(serial, 1e-300)))
    return np.minimum(1, np.exp(-half) * (1 + half + half * half / 2))


def _bins(p: np.ndarray) -> np.ndarray:
    return np.minimum(LOST, (-np.log10(np.maximum(p, 1e-300)) / STEP).astype(np.int32))


def _grouped(name: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of a token's encoding and length class."""
    return (name * len(LENGTHS) + np.searchsorted(LENGTHS, n, "right") - 1).astype(np.int32)


def tokens(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, group, bin) of all tokens that the battery tests: maximal runs of at least 12 symbols of one inferred encoding with a letter among them.

    Padding ("=") ends a token and isn't part of it. Digits alone are a number, no token.
    """
    s, e = _runs(TOKEN[data], begins, LEAST["random"])
    if not len(s):
        return s, e, np.zeros(0, np.int32), np.zeros(0, np.int32)
    n = e - s
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    raw = data[np.repeat(s - first, n) + np.arange(n.sum())]
    fits = np.bitwise_and.reduceat(_HOLDS[raw], first)
    use = (fits > 0) & (np.maximum.reduceat(raw, first) >= 65)  # letters lie above the digits
    name = np.argmax((fits[:, None] >> np.arange(len(_NAMES))) & 1, axis=1)
    s, e, n, name, raw = s[use], e[use], n[use], name[use], raw[np.repeat(use, n)]
    first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)[: len(n)]
    p = battery(_INDEX[np.repeat(name, n), raw], first, n, _SIZES[name])
    return s, e, _grouped(name, n), _bins(p)


def ordinary(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, bin) of ordinary identifiers made of each text's own words: one of every encoding and length class for every text with enough letters.

    Words are joined as people join them: in lower case, in capitals, in camel case, with "/" or "_" before words, and with two to four digits behind where the
    encoding has digits; for hexadecimal only the letters a to f are taken. The place in the text comes from the text's length.
    """
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    groups, bins = [], []
    letter = (low >= 97) & (low <= 122)
    for narrow in (True, False):
        use = np.flatnonzero(letter & (low <= 102) if narrow else letter)
        upto = np.searchsorted(use, at)
        start = np.zeros(len(data) + 1, bool)  # a word's first letter
        start[:-1] = letter
        start[1:-1] &= ~letter[:-1]
        for i, length in enumerate(LENGTHS):
            for j, encoding in enumerate(_NAMES):
                if encoding.startswith("hex") != narrow:
                    continue
                text = np.flatnonzero(np.diff(upto) >= length)
                if not len(text):
                    continue
                room = np.diff(upto)[text] - length
                shift = (mix64((at[text + 1] - at[text]).astype(np.uint64) * np.uint64(64) + np.uint64(8 * i + j)) >> np.uint64(2)).astype(np.int64)
                place = use[(upto[text] + shift % (room + 1))[:, None] + np.arange(length)]
                token, word = low[place], start[place]
                if encoding in ("upper", "base32", "hex_upper"):
                    token = token - 32
                if encoding in ("letters", "base62", "base64", "base64_url"):
                    token = np.where(word, token - 32, token)
                if encoding.startswith("base64"):
                    token[:, 1:] = np.where(word[:, 1:], ord("/" if encoding == "base64" else "_"), token[:, 1:])
                if encoding not in ("lower", "upper", "letters"):
                    tail = np.arange(length) >= length - 2 - (shift % 3)[:, None]
                    digit = 50 + (shift[:, None] // 7 + np.arange(length) * (1 + shift[:, None] // 11 % 5)) % (6 if encoding == "base32" else 8)
                    token = np.where(tail, digit, token)
                n = np.full(len(text), length)
                k = np.full(len(text), _SIZES[j])
                groups.append(np.full(len(text), j * len(LENGTHS) + i, np.int32))
                bins.append(_bins(battery(_INDEX[j, token.ravel()], np.arange(len(text)) * length, n, k)))
    return (np.concatenate(groups), np.concatenate(bins)) if groups else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _scan(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> tuple[list, pa.Array, list]:
    """Base spans of each text, its candidates, and the batch's histogram of tested tokens and ordinary identifiers (with its first row)."""
    n = len(batch)
    base: list[list] = [[] for _ in range(n)]
    begins = np.zeros(len(data) + 1, bool)
    begins[at[:-1]] = True
    begins = begins[:-1]
    point = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)  # code points up to and with each byte
    before = np.concatenate(([0], point))

    def spans(member: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, int]]:
        s, e = _runs(member[data], begins, least)
        for row, a, b in zip(np.searchsorted(at, s, "right") - 1, s, e):
            yield int(row), int(a), int(b), int(before[a] - before[at[row]]), int(before[b] - before[at[row]])

    raw = data.tobytes()
    for row in range(n):
        body = raw[at[row] : at[row + 1]]
        low = body.lower()
        if any(k in low for k in KEYWORDS):
            for m in ASSIGN.finditer(body.decode()):
                if m.end(2) - m.start(2) >= LEAST["assign"]:
                    base[row].append((m.start(), 0, m.end()))
    for row, a, b, start, end in spans(ACCESS, LEAST["access"]):
        i = raw.find(b"AKIA", a, b)
        if i >= 0 and b - i >= LEAST["access"]:
            base[row].append((start + i - a, 1, end))
    for row, _a, _b, start, end in spans(HEX, LEAST["hex"]):
        base[row].append((start, 2, end))

    s, e, group, step = tokens(data, begins)
    o_group, o_step = ordinary(data, at)
    cells = len(_NAMES) * len(LENGTHS) * (LOST + 1)
    seen, null = (np.bincount(g.astype(np.int64) * (LOST + 1) + b, minlength=cells) for g, b in ((group, step), (o_group, o_step)))
    counts: list = [None] * n
    counts[0] = [{"group": int(c) // (LOST + 1), "bin": int(c) % (LOST + 1), "tokens": int(seen[c]), "ordinary": int(null[c])} for c in np.flatnonzero(seen + null)]
    may = step < LOST
    s, e, group, step = s[may], e[may], group[may], step[may]
    row = np.searchsorted(at, s, "right") - 1
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    of = before[at[row]]
    fields = [(before[s] - of).astype(np.int32), (before[e] - of).astype(np.int32), group, step.astype(np.int32)]
    found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(CANDIDATE)))
    return [[{"start": s, "kind": k, "end": e} for s, k, e in sorted(x)] for x in base], found, counts


def found_upto(counts: list[tuple[int, int, int, int]], q: float) -> dict[int, int]:
    """For each group the last bin whose tokens are findings, by Benjamini and Hochberg: of all findings of the group at most the share ``q`` is expected to be ordinary.

    A token's p-value under "ordinary identifier" is the share of the group's ordinary identifiers that look at least as random, one more on either side.
    """
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for group, step, n, null in counts:
        groups.setdefault(group, []).append((step, n, null))
    out = {}
    for group, steps in groups.items():
        m, nulls = sum(n for _, n, _ in steps), sum(x for _, _, x in steps)
        rank = below = 0
        for step, n, null in sorted(steps):  # most random first
            rank, below = rank + n, below + null
            if step < LOST and rank and (1 + below) / (1 + nulls) <= q * rank / m:
                out[group] = step
    return out


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), q: float = 0.05) -> DataFrame:
    """The columns ``keep`` and (base, spans): the secrets of every text, as arrays of (start, kind number, end) in code points.

    Base kinds are fixed patterns. Kind ``random`` are tokens of at least 12 symbols of an inferred encoding, inside base spans too, that look more like random draws
    than ordinary identifiers do. The null is "ordinary identifier": what the battery says of identifiers joined from the words of all texts. Within each encoding and length
    class the findings are chosen by Benjamini-Hochberg at level ``q`` over the whole corpus, so of those reported at most that share is expected to be ordinary; short classes,
    where the battery can't tell, report nothing. A token that random draws of its encoding would match once in 100,000 at most is never reported. The histogram that this needs
    has at most 10 x 6 x 101 rows.

    A null text is empty and has no spans; one row comes out for each row that goes in, repeated rows too. Kept columns may have any name but ``base`` and ``spans``,
    which are an error. No rows: no rows.
    """
    clash = {"base", "spans"} & set(keep)
    if clash:
        raise ValueError(f"columns can't be kept under the names of results: {sorted(clash)}")
    added = StructType.fromDDL("secret_base array<struct<start:int,kind:int,end:int>>, secret_found array<struct<start:int,end:int,group:int,bin:int>>, secret_counts array<struct<group:int,bin:int,tokens:long,ordinary:long>>")
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    given = df.select(*kept, F.col(text).alias("scanned_text"))
    schema = StructType(given.drop("scanned_text").schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in slices(whole, "scanned_text", PART):
                base, found, counts = _scan(batch, data, at)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, pa.list_(SPAN)), found, pa.array(counts, pa.list_(COUNT))], schema.names)

    scanned = written(given.mapInArrow(run, schema))
    counts = scanned.select(F.explode("secret_counts").alias("c")).groupBy("c.group", "c.bin").agg(F.sum("c.tokens"), F.sum("c.ordinary")).collect()  # bounded: groups x bins
    last = found_upto([tuple(r) for r in counts], q)

    def random(f: Column) -> Column:
        return F.lit(False) if not last else F.coalesce(f["bin"] <= F.element_at(F.create_map(*[F.lit(x) for kv in last.items() for x in kv]), f["group"]), F.lit(False))

    more = F.transform(F.filter("secret_found", random), lambda f: F.struct(f["start"].alias("start"), F.lit(3).alias("kind"), f["end"].alias("end")))
    names = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]
    return scanned.select(*names, F.col("secret_base").alias("base"), F.array_sort(F.concat("secret_base", more)).alias("spans"))


def label(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark. Spans are sorted by start; null texts and spans stay.

    A text is put together from the slices between its spans, so the work grows with the text and with the spans, not with their product.
    """

    @F.pandas_udf("string")
    def blotted(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, found):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            parts, at = [], 0
            for s, e in zip(own[::2].tolist(), own[1::2].tolist()):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    some = F.size(spans) > 0  # only these texts travel
    ends = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    return F.when(some, blotted(F.when(some, text), ends)).otherwise(text)
