"""Fill-in-middle form of texts, cut at lines that a byte automaton counts and finds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, refuse, utf8

#: What marks the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = ("units", "form", "prefix_chars", "middle_chars", "output")
#: Bytes of a segment that is scanned in one go, and of the texts that are held at a time.
SEGMENT, HELD = 512, 1 << 23
#: A transition's counts in one number: characters, units and sentinels that end with its byte.
CHAR, UNIT, SENTINEL = 1, 1 << 20, 1 << 40
MASK = (1 << 20) - 1


@dataclass
class Automaton:
    """``next[state * 256 + byte]`` and what that transition counts. State 0 is the start of a unit; ``after[byte]`` has the states that a byte can lead to."""

    next: np.ndarray
    count: np.ndarray
    after: list[np.ndarray]


def automaton(sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    """The table over bytes: the start of a unit, the sentinels' prefixes (with their fallbacks), and one to three UTF-8 continuation bytes to come.

    A line feed ends a unit. A character counts at its first byte; continuation bytes count nothing and end no unit.
    """
    words = [s.encode() for s in sentinels]
    if any(not w or not w.isascii() or b"\n" in w for w in words):
        raise ValueError("sentinels are ASCII, not empty and without line feeds")
    prefixes = sorted({w[:i] for w in words for i in range(1, len(w) + 1)})
    inside = {b"": 1} | {p: i + 2 for i, p in enumerate(prefixes)}
    pending = [len(inside) + 1 + i for i in range(3)]  # states of 1, 2, 3 continuation bytes to come
    states = len(inside) + 4
    step, count = np.zeros((states, 256), np.uint8), np.zeros((states, 256), np.int64)
    seen = {0: b"", **{i: p for p, i in inside.items()}, **dict.fromkeys(pending, b"")}
    for state, prefix in seen.items():
        for byte in range(256):
            if byte == 10:
                step[state, byte], count[state, byte] = 0, CHAR + UNIT
            elif byte < 0x80:
                got = prefix + bytes([byte])
                ends = any(got.endswith(w) for w in words)
                while got not in inside:
                    got = got[1:]
                step[state, byte], count[state, byte] = inside[got], CHAR + SENTINEL * ends
            elif byte < 0xC0:
                left = pending.index(state) if state in pending else 0
                step[state, byte] = pending[left - 1] if left else 1
            else:
                step[state, byte], count[state, byte] = pending[(byte >= 0xE0) + (byte >= 0xF0)], CHAR
    return Automaton(step.ravel(), count.ravel(), [np.unique(step[:, b]) for b in range(256)])


def _scan(a: Automaton, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lanes in step, from their states: (last state, counts, bytes read). With ``upto``, counts and bytes are those at the end of that unit of the lane."""
    order = np.argsort(-size, kind="stable")
    start, state, total, long = start[order], state[order].astype(np.int64), np.zeros(len(order), np.int64), size[order]
    need = None if upto is None else upto[order]
    found, read = np.zeros(len(order), np.int64), long.copy()
    for j in range(int(long[0]) if len(long) else 0):
        m = int(np.searchsorted(-long, -j, "left"))  # lanes of over j bytes
        at = state[:m] * 256 + data[start[:m] + j]
        total[:m] += a.count[at]
        state[:m] = a.next[at]
        if need is not None:
            hit = np.flatnonzero(((total[:m] >> 20) & MASK == need[:m]) & (found[:m] == 0))
            found[hit], read[hit] = total[hit], j + 1
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return state[back], (total if need is None else found)[back], read[back]


@dataclass
class Counted:
    """Of some texts: their units, characters and sentinels, and for each segment its text, place, start state and the counts before it."""

    units: np.ndarray
    chars: np.ndarray
    sentinels: np.ndarray
    of: np.ndarray
    start: np.ndarray
    size: np.ndarray
    state: np.ndarray
    lines_before: np.ndarray
    chars_before: np.ndarray


def counted(a: Automaton, data: np.ndarray, at: np.ndarray, segment: int = SEGMENT) -> Counted:
    """One scan over all bytes. A text's later segments run from every state that the byte before them allows (mostly one), then the right runs are chained."""
    length = np.diff(at)
    parts = -(-length // segment)
    of = np.repeat(np.arange(len(length)), parts)
    first = np.concatenate(([0], np.cumsum(parts)))
    nth = np.arange(len(of)) - first[of]
    start = at[of] + nth * segment
    size = np.minimum(segment, at[of + 1] - start)
    options = [np.zeros(1, np.uint8) if k == 0 else a.after[data[s - 1]] for k, s in zip(nth.tolist(), start.tolist())]
    lanes = np.repeat(np.arange(len(of)), [len(o) for o in options])
    begin = np.concatenate(options) if options else np.zeros(0, np.uint8)
    end, total, _ = _scan(a, data, start[lanes], size[lanes], begin)
    states = len(a.next) // 256
    lane_of = np.zeros((len(of), states), np.int64)
    lane_of[lanes, begin] = np.arange(len(lanes))
    state, lane = np.zeros(len(length), np.int64), np.zeros(len(of), np.int64)
    for k in range(int(parts.max()) if len(parts) else 0):
        texts = np.flatnonzero(parts > k)
        own = first[texts] + k
        lane[own] = lane_of[own, state[texts]]
        state[texts] = end[lane[own]]
    total = total[lane] if len(lane) else np.zeros(0, np.int64)
    counts = [total & MASK, total >> 20 & MASK, total >> 40]
    upto = [np.concatenate(([0], np.cumsum(c))) for c in counts]
    chars, lines, marks = (u[first[1:]] - u[first[:-1]] for u in upto)
    before = [u[:-1] - u[first[of]] for u in upto[:2]]
    return Counted(lines + (state != 0), chars, marks, of, start, size, begin[lane] if len(lane) else begin, before[1], before[0])


def located(a: Automaton, data: np.ndarray, at: np.ndarray, got: Counted, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, character) at which each text's first ``unit`` units end: only the segments that hold these ends are scanned again."""
    byte, char = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
    last = unit >= got.units
    byte[last], char[last] = np.diff(at)[last], got.chars[last]
    texts = np.flatnonzero(~last & (unit > 0))
    if len(texts):
        # Within a text, the last segment with fewer line ends before it than asked for; texts follow each other by steps larger than any count.
        step = int(got.units.max()) + 1
        seg = np.searchsorted(got.of * step + got.lines_before, texts * step + unit[texts], "left") - 1
        _, found, read = _scan(a, data, got.start[seg], got.size[seg], got.state[seg], unit[texts] - got.lines_before[seg])
        byte[texts], char[texts] = got.start[seg] - at[texts] + read, got.chars_before[seg] + (found & MASK)
    return byte, char


def fill_in_middle(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, keep: tuple[str, ...] = (), sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """(doc_id, the columns ``keep``, units, form, prefix_chars, middle_chars, output): every text cut at line ends into prefix, middle and suffix.

    The first four 8-digit groups of the SHA-256 of ``seed:doc_id`` choose the two cuts, whether a text is transformed (``rate`` of 100) and in which order (``spm`` of 100): ``psm`` is
    prefix, suffix, middle, ``spm`` suffix, prefix, middle, each after its sentinel. Empty texts and those that hold a sentinel stay ``plain``; their lengths are null. Lengths are in code points.

    A null text is empty, a null id counts as an empty one. Equal ids with equal texts give equal rows. Texts of any length: they are scanned in segments, 8 MB of texts at a time (one text at least).
    No rows: no rows. A kept column with the name of a result is an error.
    """
    refuse(keep, ("doc_id", *RESULTS, "_text", "_h1", "_h2", "_h3", "_h4"))
    table = automaton(sentinels)
    marks = [s.encode() for s in sentinels]
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    rows = df.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"), *h)
    schema = df.select(F.col(doc_id).alias("doc_id"), *keep).schema
    for name, kind in zip(RESULTS, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "_text", HELD):
                data, at = utf8(batch.column("_text"))
                h1, h2, h3, h4 = (batch.column(f"_h{i}").to_numpy() for i in (1, 2, 3, 4))
                got = counted(table, data, at)
                plain = (got.chars == 0) | (got.sentinels > 0) | (h3 % 100 >= rate)
                u, v = h1 % (got.units + 1), h2 % (got.units + 1)
                (a, a_chars), (b, b_chars) = (located(table, data, at, got, x) for x in (np.minimum(u, v), np.maximum(u, v)))
                suffix_first = h4 % 100 < spm
                out, raw = [], data.tobytes()
                for i in range(len(batch)):
                    body = raw[at[i] : at[i + 1]]
                    if not plain[i]:
                        pre, suf = marks[0] + body[: a[i]], marks[1] + body[b[i] :]
                        body = (suf + pre if suffix_first[i] else pre + suf) + marks[2] + body[a[i] : b[i]]
                    out.append(body)
                form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
                cols = [batch.column(c) for c in ("doc_id", *keep)]
                cols += [pa.array(got.units), pa.array(form.tolist(), pa.string()), pa.array(a_chars, mask=plain), pa.array(b_chars - a_chars, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output and its form come from: what stands between the sentinels, in order. Exact, as a transformed text holds no sentinel."""
    p, s, m = sentinels
    head = F.substring_index(output, m, 1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substr(head, F.lit(len(p) + 1)), s, 1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substr(head, F.lit(len(s) + 1)), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
