"""Harmonic packing of token sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vector import slices

END_ID = 2
#: Words that a task remembers; once it is full, other words are encoded each time.
REMEMBERED = 600_000
#: Pieces dealt to one group of bins; groups fill their bins independently.
GROUP_PIECES = 8192


def classes(capacity: int) -> list[int]:
    """How many pieces a bin of each class holds: powers of two and one and a half times those."""
    out, k = {1}, 1
    while k <= capacity:
        out |= {k, k + k // 2}
        k *= 2
    return sorted(x for x in out if x <= capacity)


def cuts(capacity: int, slack: float = 1 / 32) -> list[tuple[tuple[int, int], ...]]:
    """For each length below capacity, its pieces (length, class).

    A length goes to the class with the smallest slot (capacity // class) that holds it. Where that wastes over ``slack`` of the slot,
    a piece that exactly fills the next smaller slot is cut off and the rest is classed anew.
    """
    ks = classes(capacity)
    slots = [capacity // k for k in ks]
    out: list[tuple[tuple[int, int], ...]] = [()]
    for n in range(1, capacity):
        i = max(j for j, s in enumerate(slots) if s >= n)
        if slots[i] - n > max(1, slots[i] * slack) and i + 1 < len(ks) and slots[i + 1] < n:
            out.append(((slots[i + 1], ks[i + 1]), *out[n - slots[i + 1]]))
        else:
            out.append(((n, ks[i]),))
    return out


#: How byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_MARKS = ".,;:!?"
# The normalizer and the splitter for which words may be encoded one by one. With any other, texts are encoded whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@lru_cache(2)
def _loaded(tokenizer: str):
    """The tokenizer, once for each worker process, and whether words may be encoded one by one."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    made = json.loads(tok.to_str())
    return tok, (made["normalizer"], made["pre_tokenizer"]) == (_NORMALIZER, _SPLITTER)


def _encoder(tokenizer: str):
    """bytes of a text -> little-endian bytes of its ids; one for each task, so that an idle worker keeps no words.

    White space only parts words, so words are encoded once and remembered. Plain Latin letters, with or without marks behind, go to the
    tokenizer's model at once: its normalizer would only lower them and its splitter only part the marks. All else is encoded whole. Tokenizers that
    normalize or split otherwise encode every text whole.
    """
    tok, by_word = _loaded(tokenizer)
    if not by_word:
        return lambda body: np.array(tok.encode(body.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    known: dict[bytes, bytes] = {}

    def model(piece: str) -> bytes:
        return np.array([t.id for t in tok.model.tokenize("".join([_BYTE[b] for b in piece.encode()]))], "<u4").tobytes()

    def word(w: bytes) -> bytes:
        s = w.decode()
        low = s.lower()
        core = low.rstrip(_MARKS)
        if len(low) == len(s) and _LETTERS.fullmatch(core):
            key = core.encode()
            ids = known.get(key) or model(core)
            if len(known) < REMEMBERED:
                known[key] = ids
            if len(core) < len(low):
                ids += model(low[len(core) :])
        else:
            ids = np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        if len(known) < REMEMBERED:
            known[w] = ids
        return ids

    def encode(body: bytes) -> bytes:
        words = (body if b"<|" in body else body.lower()).split()  # special tokens are told by their case
        parts = [known.get(w) for w in words]
        if None in parts:
            parts = [word(w) if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)

    return encode


def pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, class): the pieces of every document, each with its class.

    The ids are those of the tokenizer on the whole text, without special tokens, and one end id. Null and empty texts have the end id only.
    """
    table = cuts(capacity)
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for batch, data, at in slices(whole, "text", 1 << 20):
                raw = data.tobytes()
                rows: list[tuple] = []
                for i in range(len(batch)):
                    ids = encode(raw[at[i] : at[i + 1]]) + end
                    n, start = len(ids) // 4, 0
                    for length, k in [(capacity, 1)] * (n // capacity) + list(table[n % capacity]):
                        rows.append((i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k))
                        start += length
                row, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *[pa.array(x, pa.int64()) for x in rest]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])

    shape = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, class long"
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, shape)


def fill(lengths: np.ndarray, ks: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: bins of a class take its count of pieces; what is left of all classes goes to shared bins."""
    n = len(lengths)
    order = np.argsort(ks, kind="stable")
    k = ks[order]
    first = np.searchsorted(k, k)
    nth = np.arange(n) - first
    total = np.searchsorted(k, k, "right") - first
    full = nth < total // k * k
    key = k * (n + 1) + nth // k
    bins = np.full(n, -1, np.int64)
    _, bins_full = np.unique(key[full], return_inverse=True)
    bins[full] = bins_full
    used = int(bins_full.max()) + 1 if full.any() else 0
    rest: dict[int, list[int]] = {}
    for i in np.flatnonzero(~full):
        rest.setdefault(int(k[i]), []).append(i)
    room: list[int] = []  # first fit, fullest first; there are at most as many parts as classes
    for part in sorted(rest.values(), key=lambda p: -int(lengths[order[p]].sum())):
        need = int(lengths[order[part]].sum())
        b = next((b for b, r in enumerate(room) if r >= need), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= need
        bins[part] = used + b
    out = np.empty(n, np.int64)
    out[order] = bins
    by = np.lexsort((np.arange(n), out))
    ends = np.cumsum(lengths[by])
    start = np.searchsorted(out[by], out[by])
    offset = np.empty(n, np.int64)
    offset[by] = ends - lengths[by] - (ends[start] - lengths[by][start])
    return out, offset


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece in its place.

    Documents are cut into pieces by reciprocal-capacity classes: a bin of class k holds k pieces of at most capacity // k tokens. Pieces are dealt
    by a hash of their running number to groups of about 8192, and every group fills its own bins, so workers need not talk; a group leaves at most
    one unfinished bin for each class, and these share bins where they fit. Repeated rows are packed each. No rows: no rows.
    """
    got = written(pieces(df, tokenizer, doc_id, text, capacity))
    groups = max(1, -(-got.count() // GROUP_PIECES))
    id_type = got.schema["doc_id"].dataType.simpleString()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("class", "doc_id", "start", "ids_crc32")])
        bins, offset = fill(t["length"].to_numpy(), t["class"].to_numpy(), capacity)
        first = t["group"][0].as_py() << 24
        return t.select(names).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offset))

    shape = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # Rows of the written pieces are numbered, so null or repeated ids spread as all others do.
    return got.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("group").applyInArrow(run, shape)
