"""Media columns: texts stored as lossless WebP images and read back, and pixel arrays of any lossless WebP column."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import webp
from tidemark.llm.common import refuse
from tidemark.llm.vector import slices

#: A payload is a whole number of rows of 192 pixels, three bytes each; an image has at most 16 rows, so no step's work grows with a text.
WIDTH, ROWS, UNIT, FILL = 192, 16, 576, 255


def split_images(media: bytes) -> list[bytes]:
    """The WebP files that follow each other in a value."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0] if at + 8 <= len(media) else len(media)
        out.append(media[at : at + n])
        at += n
    return out


def store_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, as WebP files in one value.

    A null text is empty: one row of fill. Equal texts give equal media. Repeated rows are stored each. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in slices(whole, "text", 2 << 20):
                n = np.diff(at)
                rows = np.maximum(1, -(-n // UNIT))
                first = np.concatenate(([0], np.cumsum(rows)))
                payload = np.full(int(first[-1]) * UNIT, FILL, np.uint8)
                payload[np.repeat(first[:-1] * UNIT - at[:-1], n) + np.arange(len(data))] = data
                images = -(-rows // ROWS)
                upto = np.cumsum(images)
                heights = np.full(int(upto[-1]), ROWS)
                heights[upto - 1] = rows - (images - 1) * ROWS
                files = webp.encode_payloads(payload, heights, WIDTH)
                media = [b"".join(files[b - a : b]) for a, b in zip(images, upto)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    id_type = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def _groups(values: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of values with about ``most`` bytes each."""
    a = 0
    while a < len(values):
        b, n = a, 0
        while b < len(values) and (b == a or n + len(values[b]) <= most):
            n += len(values[b])
            b += 1
        yield a, b
        a = b


def read_back(df: DataFrame, doc_id: str = "doc_id", media: str = "media", also: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Digests and features of payloads, from their decoded pixels: what ``store_texts`` made is read, nothing else.

    ``feature`` has the images' count and size, and each channel's mean and standard deviation in tenths. Null or empty media have no payload: nulls, and 0 media bytes. A column of ``also`` with the name of a
    result is an error.
    """
    refuse(also, ("doc_id", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch.column("media").to_pylist()]
            for a, b in _groups(values):
                files = [split_images(v) for v in values[a:b]]
                decoded = iter(webp.decode([f for own in files for f in own]))
                rows: list[tuple] = []
                for value, own in zip(values[a:b], files):
                    if not own:
                        rows.append((None, None, None, 0, None, None))
                        continue
                    images = [next(decoded) for _ in own]
                    px = np.concatenate([p for _, _, p in images])
                    channels = np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1]
                    payload = channels.tobytes()
                    mean = np.rint(channels.mean(axis=0) * 10).astype(int)
                    spread = np.rint(channels.std(axis=0) * 10).astype(int)
                    feature = f"{len(own)}:{images[0][0]}x{sum(h for _, h, _ in images)}:{','.join(map(str, mean))}:{','.join(map(str, spread))}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(value), hashlib.sha256(value).hexdigest(), feature))
                part = batch.slice(a, b - a)
                cols = [part.column(c) for c in ("doc_id", *also)] + [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *also, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kept = df.select(F.col(doc_id).alias("doc_id"), *also, F.col(media).alias("media"))
    schema = kept.drop("media").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    return kept.mapInArrow(run, schema)


def pixel_arrays(df: DataFrame, key: str, media: str = "media", most_pixels: int = webp.MOST_PIXELS) -> DataFrame:
    """(key, image, width, height, pixels, error): one row for each WebP file of a value; pixels are 32-bit ARGB, little-endian, by rows.

    A file that can't be decoded, or claims more than ``most_pixels``, has null pixels and the reason in ``error``. Null and empty values have no images. A key that has
    the name of a result is an error.
    """
    if key in ("image", "width", "height", "pixels", "error"):
        raise ValueError(f"the key can't be called {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch.column("media").to_pylist()]
            for a, b in _groups(values):
                files = [(i, k, f) for i in range(a, b) for k, f in enumerate(split_images(values[i]))]
                try:
                    got: list = webp.decode([f for _, _, f in files], most_pixels)
                except (webp.WebPError, IndexError, ValueError):
                    got = [_one(f, most_pixels) for _, _, f in files]
                if not files:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array([i for i, _, _ in files])),
                        pa.array([k for _, k, _ in files], pa.int32()),
                        pa.array([None if isinstance(g, str) else g[0] for g in got], pa.int32()),
                        pa.array([None if isinstance(g, str) else g[1] for g in got], pa.int32()),
                        pa.array([None if isinstance(g, str) else g[2].astype("<u4").tobytes() for g in got], pa.binary()),
                        pa.array([g if isinstance(g, str) else None for g in got], pa.string()),
                    ],
                    [key, "image", "width", "height", "pixels", "error"],
                )

    schema = df.select(key).schema
    for name, kind in (("image", "integer"), ("width", "integer"), ("height", "integer"), ("pixels", "binary"), ("error", "string")):
        schema = schema.add(name, kind)
    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, schema)


def _one(file: bytes, most_pixels: int) -> tuple | str:
    try:
        return webp.decode([file], most_pixels)[0]
    except (webp.WebPError, IndexError, ValueError) as e:
        return str(e) or "broken"
