import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.webp_writer import Writer
from tidemark.llm import media, webp


def payload(text):
    b = (text or "").encode()
    return b + b"\xff" * (-len(b) % 576 if b else 576)


def test_texts_come_back_from_their_images(tricky, docs):
    rows = tricky.select("doc_id", "text").union(docs.select("doc_id", "text"))
    texts = sorted((hashlib.sha256(payload(r["text"])).hexdigest(), len((r["text"] or "").encode()), len(payload(r["text"]))) for r in rows.collect())
    got = media.read_back(media.store_texts(rows)).collect()
    assert texts == sorted((r["payload_sha256"], r["n_bytes"], r["payload_bytes"]) for r in got)


def test_equal_texts_have_equal_media(tricky):
    got = media.read_back(media.store_texts(tricky)).filter("doc_id in (1, 2)").select("media_sha256", "feature").distinct()
    assert got.count() == 1


def test_no_rows(empty):
    assert media.read_back(media.store_texts(empty)).count() == 0


def test_a_known_file():
    w, h, px = webp.decode([base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")])[0]
    assert (w, h, px.tolist()) == (1, 1, [0])


def image(w, h, colours=None, seed=1):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32), w * h)
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return (0xFF000000 | ((x * 3 + rng.integers(0, 3, (h, w))) & 255) << 16 | ((y * 5) & 255) << 8 | ((x + y) & 255)).astype(np.uint32).ravel()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    px = image(13, 9)
    assert (webp.decode([Writer(13, 9).predictor(px, mode, 2)])[0][2] == px).all()


def test_cross_colour_subtract_green_and_both():
    px = image(17, 5)
    for file in (Writer(17, 5).cross_colour(px, 0x00F31C40, 2), Writer(17, 5).subtract_green(px), Writer(17, 5).green_then_predictor(px, 11, 3)):
        assert (webp.decode([file])[0][2] == px).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    px = image(11, 7, colours)
    assert (webp.decode([Writer(11, 7).palette(px)])[0][2] == px).all()


def test_back_references_cache_and_groups():
    px = np.tile(image(10, 2, 5), 6)
    for file in (Writer(10, 12).references(px, 20), Writer(10, 12).references(px, 20, cache=4), Writer(10, 12).groups(px, 2)):
        assert (webp.decode([file])[0][2] == px).all()


def test_images_of_all_kinds_at_once_and_broken_ones(spark):
    px = image(13, 9)
    files = [Writer(13, 9).predictor(px, 12, 3), Writer(13, 9).palette(image(13, 9, 3)), Writer(13, 9).plain(px)]
    df = spark.createDataFrame([(1, bytearray(b"".join(files))), (2, bytearray(b"RIFFnothing")), (3, None), (4, bytearray(files[0][:40]))], "id int, media binary")
    got = {(r["id"], r["image"]): r for r in media.pixel_arrays(df, "id").collect()}
    assert np.frombuffer(got[1, 0]["pixels"], "<u4").tolist() == px.tolist() and got[1, 2]["width"] == 13
    assert got[2, 0]["pixels"] is None and got[2, 0]["error"]
    assert got[4, 0]["error"] and (3, 0) not in got


def test_damaged_files_end_soon():
    """Truncated files and files with wrong bytes, many of which claim large images: decoded or refused, each within a second."""
    import struct
    import time

    rng = np.random.default_rng(11)
    px = image(40, 30)
    files = [Writer(40, 30).plain(px), Writer(40, 30).predictor(px, 11, 3), Writer(40, 30).palette(image(40, 30, 5)), Writer(40, 30).references(np.tile(image(40, 5, 5), 6), 50, cache=4)]
    for i in range(1000):
        f = bytearray(files[i % len(files)])
        for j in rng.integers(20, len(f), rng.integers(0, 4)):
            f[j] = rng.integers(0, 256)
        if i % 3 == 0:
            f[21:25] = struct.pack("<I", 1999 | 1999 << 14)
        f = bytes(f[: rng.integers(26, len(f) + 1)]) if i % 2 else bytes(f)
        start = time.perf_counter()
        got = media._one(f, webp.MOST_PIXELS)
        assert (isinstance(got, str) or len(got[2]) == got[0] * got[1]) and time.perf_counter() - start < 1
    huge = bytearray(files[0])
    huge[21:25] = struct.pack("<I", 16383 | 16383 << 14)
    assert "pixels" in media._one(bytes(huge), webp.MOST_PIXELS)


def test_predictor_of_a_large_image_is_fast_and_edges_are_right():
    import time

    px = image(700, 500)
    modes = np.random.default_rng(1).integers(0, 14, 44 * 32).astype(np.uint32)
    start = time.perf_counter()
    assert (webp.predictor(webp.predictor(px, 700, modes, 4, False), 700, modes, 4, True) == px).all()
    assert time.perf_counter() - start < 20
    for w, h in ((1, 5), (5, 1), (2, 2), (1, 1)):
        small = image(w, h)
        assert (webp.predictor(webp.predictor(small, w, modes, 2, False), w, modes, 2, True) == small).all()


def test_media_that_are_null_or_empty(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, bytearray(b""), 0)], "doc_id long, media binary, n_bytes long")
    assert [(r["payload_bytes"], r["media_bytes"]) for r in media.read_back(rows).collect()] == [(None, 0)] * 2
    with pytest.raises(ValueError):
        media.pixel_arrays(rows.withColumnRenamed("doc_id", "width"), "width")


def test_digests_of_the_query_are_those_of_plain_python(spark):
    """Payload and stored form, from scratch: bytes filled up, digests, the last 32 bytes; media hold what a decoder of one file at a time reads."""
    import hashlib
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stored = {r["doc_id"]: r["media"] for r in media.store_texts(docs).collect()}
    got = {r["doc_id"]: r for r in media.read_back(media.store_texts(docs)).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        b = (t or "").encode()
        payload = b + b"\xff" * (576 * max(1, -(-len(b) // 576)) - len(b))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[d]), hashlib.sha256(stored[d]).hexdigest())
        images = [webp.decode([f])[0] for f in media.split_images(stored[d])]
        x = np.concatenate([p for _, _, p in images])
        channels = np.stack([(x >> s) & 255 for s in (16, 8, 0)], 1)
        assert channels.astype(np.uint8).tobytes() == payload
        tenths = [",".join(str(int(v)) for v in np.rint(f(axis=0) * 10)) for f in (channels.mean, channels.std)]
        assert r["feature"] == f"{len(images)}:{images[0][0]}x{sum(h for _, h, _ in images)}:{tenths[0]}:{tenths[1]}"


def test_random_payloads():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 17, 40)
    data = np.where(rng.random(int(rows.sum()) * 576) < 0.3, 32, rng.integers(0, 256, int(rows.sum()) * 576)).astype(np.uint8)
    px = np.concatenate([p for _, _, p in webp.decode(webp.encode_payloads(data, rows, 192))])
    assert (np.stack(((px >> 16) & 255, (px >> 8) & 255, px & 255), 1).ravel() == data).all()


def test_query_on_a_small_table(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op1_lossless_webp"](spark, "/root/testdata/sf0.001")
    assert got.count() == got.filter(F.length("media_sha256") == 64).count() == 200


def transforms(file):
    """The kinds of a file's first transform, if any."""
    head = int.from_bytes(file[20:32], "little") >> 40
    return (head >> 1) & 3 if head & 1 else None


def test_the_encoder_writes_transforms_where_they_are_shorter():
    """Steps from the left or above, channels that follow green, and few colours: the file has the transform, and comes back as it was, whatever images lie beside it."""
    rng = np.random.default_rng(5)
    rows = np.array([16, 16, 1, 16, 3, 16])
    n = int(rows.sum()) * 192
    walk = np.cumsum(rng.integers(-2, 3, (n, 3)), axis=0)
    above = np.cumsum(rng.integers(0, 2, (n // 192, 192, 3)), axis=0) + rng.integers(0, 256, (1, 192, 3))
    green = rng.integers(0, 256, n)
    follow = np.stack((green + rng.integers(0, 2, n), green, green + rng.integers(0, 2, n)), 1)
    steps = np.cumsum(rng.integers(-20, 21, n))
    both = np.stack((steps, steps, steps + rng.integers(0, 2, n)), 1)
    few = rng.integers(0, 256, (250, 3))[rng.integers(0, 250, n)]
    texts = rng.integers(97, 123, (n, 3))
    for pixels, kind in ((walk, 0), (above, 0), (follow, 1), (both, 0), (few, 3), (texts, None)):
        data = pixels.astype(np.uint8).ravel()
        files = webp.encode_payloads(data, rows, 192)
        px = np.concatenate([p for _, _, p in webp.decode(files)])
        assert (np.stack(((px >> 16) & 255, (px >> 8) & 255, px & 255), 1).ravel() == data).all() and ((px >> 24) == 255).all()
        assert transforms(files[0]) == kind
        at = np.concatenate(([0], np.cumsum(rows))) * 576
        assert files == [webp.encode_payloads(data[a:b], rows[i : i + 1], 192)[0] for i, (a, b) in enumerate(zip(at, at[1:]))]


def test_palettes_of_any_size_and_fill():
    rng = np.random.default_rng(6)
    for colours in (1, 2, 3, 5, 16, 17, 256, 257):
        data = np.concatenate((rng.integers(0, 256, (colours, 3))[rng.integers(0, colours, 2 * 192)].ravel(), np.full(576, 255))).astype(np.uint8)
        px = webp.decode(webp.encode_payloads(data, np.array([3]), 192))[0][2]
        assert (np.stack(((px >> 16) & 255, (px >> 8) & 255, px & 255), 1).ravel() == data).all()


def test_one_mode_is_inverted_as_by_diagonals():
    px = image(23, 17)
    for mode in (1, 2):
        coded = webp.predictor(px, 23, np.full(1, mode), 9, False)
        assert (webp.predictor(coded, 23, np.full(1, mode), 9, True) == px).all()


def extended(file, *before, size=None, after=((b"EXIF", b"abc"), (b"XMP ", b"some text"))):
    """A simple file's image in an extended container, among other chunks."""
    n = int.from_bytes(file[16:20], "little")
    body = file[20 : 20 + n]
    w, h, _ = webp.decode([file])[0]
    w, h = size or (w, h)
    head = b"VP8X" + (10).to_bytes(4, "little") + bytes([0x1C, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    chunk = lambda tag, data: tag + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    out = b"WEBP" + head + b"".join(chunk(*c) for c in (*before, (b"VP8L", body), *after))
    return b"RIFF" + len(out).to_bytes(4, "little") + out


def test_extended_containers_hold_the_same_image(spark):
    rng = np.random.default_rng(7)
    plain = webp.encode_payloads(rng.integers(0, 256, 192 * 3 * 7, dtype=np.uint8), np.array([3, 1, 3]), 192)
    files = [extended(plain[0]), extended(plain[1], (b"ICCP", b"profile"), after=()), plain[2]]
    for (w, h, p), (x, y, q) in zip(webp.decode(files), webp.decode(plain)):
        assert (w, h) == (x, y) and (p == q).all()
    bad = [extended(plain[0], (b"ANIM", b"123456")), extended(plain[0], (b"ALPH", b"1")), extended(plain[0], size=(192, 4)), extended(plain[0])[:40], extended(plain[0])[:28]]
    no_image = extended(plain[0]).replace(b"VP8L", b"ZZZZ")
    for f in [*bad, no_image]:
        with pytest.raises(ValueError):
            webp.decode([f])
    df = spark.createDataFrame([(1, bytearray(files[0] + plain[2])), (2, bytearray(bad[0]))], "id long, media binary")
    got = sorted((r["id"], r["image"], r["height"], r["error"] is None) for r in media.pixel_arrays(df, "id").collect())
    assert got == [(1, 0, 3, True), (1, 1, 3, True), (2, 0, None, False)]


def test_the_query_of_pixel_arrays_has_every_pixel(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {(r["doc_id"], r["image"]): r for r in QUERIES["media_pixel_arrays"](spark, sf).collect()}
    n = 0
    for d, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        rows = np.frombuffer(payload(text), np.uint8).reshape(-1, 192, 3)
        for k in range(0, len(rows), media.ROWS):
            part = rows[k : k + media.ROWS]
            argb = np.concatenate((part[:, :, ::-1], np.full((*part.shape[:2], 1), 255, np.uint8)), axis=2)
            r = got[d, k // media.ROWS]
            assert (r["width"], r["height"], r["error"], r["pixels_sha256"]) == (192, len(part), None, hashlib.sha256(argb.tobytes()).hexdigest())
            n += 1
    assert n == len(got)


def test_a_pixel_takes_one_look_at_the_bits(monkeypatch):
    """Green, red and blue of a step come from the same bits, not from a read each."""
    reads, read = [], webp.Codes.read
    monkeypatch.setattr(webp.Codes, "read", lambda *a: reads.append(1) or read(*a))
    data = np.random.default_rng(0).integers(0, 256, 4 * 576, dtype=np.uint8)
    (width, height, px), = webp.decode(webp.encode_payloads(data, np.array([4]), 192))
    assert (width, height) == (192, 4) and np.array_equal(np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel(), data)
    assert len(reads) < 2 * 768  # those of code lengths only; a read for each channel took 3 * 768 more
