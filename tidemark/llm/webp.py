"""Lossless WebP: a decoder for many images at once, and an encoder for byte payloads.

Images are lanes of numpy arrays: every step decodes one symbol of each image, so the Python work is a step's, not a pixel's. The decoder
takes all of the format: prefix codes of 1 to 15 bits, prefix-code groups, back-references, colour caches, and the predictor,
cross-colour, subtract-green and colour-indexing transforms. The encoder writes a palette, a predictor or a cross-colour transform where that gives a
shorter file. Pixels are ARGB in 32 bits.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
GREENS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = np.uint32(0x1E35A7BD)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = range(4)
BLACK = np.uint32(0xFF000000)

#: Short distance codes stand for neighbours (x, y) up to 8 to the left and right and 7 above, by distance.
NEIGHBOURS = np.array(sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))

_all = np.arange(1 << 15)
REVERSED = sum(((_all >> i) & 1) << (14 - i) for i in range(15)).astype(np.int64)


class WebPError(ValueError):
    pass


# ---------------------------------------------------------------- bits and prefix codes


#: Pixels of one image; larger ones are refused, as their pixels would have to fit in one task.
MOST_PIXELS = 1 << 22


class Bits:
    """All images' bytes in one buffer; positions are bits in it."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        self.words = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
        self.end = 8 * len(data)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position on; zeros beyond the end."""
        at = np.minimum(at, self.end)
        return self.words[at >> 3] >> (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """The next n bits of every position, which move on."""
        got = (self.peek(at) & ((np.uint64(1) << np.asarray(n, np.uint64)) - np.uint64(1))).astype(np.int64)
        at += n
        return got


class Codes:
    """Prefix codes, one for each row of a matrix of code lengths, as joined tables of (symbol << 4 | length)."""

    def __init__(self, lengths: np.ndarray):
        rows, n = lengths.shape
        used = lengths > 0
        single = used.sum(axis=1) == 1
        bits = np.where(single, 0, lengths.max(axis=1, initial=0))
        none = ~used.any(axis=1)
        if none.any():
            raise WebPError("a prefix code without symbols")
        row, symbol = np.nonzero(used)
        length = np.where(single[row], 0, lengths[row, symbol])
        order = np.lexsort((symbol, length, row))
        row, symbol, length = row[order], symbol[order], length[order]
        spread = np.int64(1) << (bits[row] - length)
        size = np.int64(1) << bits
        if not np.array_equal(np.bincount(row, spread, rows).astype(np.int64), size):
            raise WebPError("a prefix code that isn't complete")
        self.table = np.repeat((symbol << 4 | length).astype(np.int32), spread)
        self.first = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.drop = 15 - bits
        self.trivial = bits == 0

    def read(self, bits: Bits, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next symbol of every position by its code; positions move on."""
        entry = self.table[self.first[code] + (REVERSED[(bits.peek(at) & np.uint64(0x7FFF)).astype(np.int64)] >> self.drop[code])]
        at += entry & 15
        return (entry >> 4).astype(np.int64)


def _read_lengths(bits: Bits, at: np.ndarray, n: int) -> np.ndarray:
    """The code lengths of one alphabet of n symbols, for every position."""
    lanes = len(at)
    out = np.zeros((lanes, n), np.int64)
    simple = np.flatnonzero(bits.take(at, 1))
    if len(simple):
        p = at[simple]
        two, eight = bits.take(p, 1), bits.take(p, 1)
        symbol = bits.take(p, np.where(eight == 1, 8, 1))
        out[simple, symbol] = 1
        second = simple[two == 1]
        q = p[two == 1]
        out[second, bits.take(q, 8)] = 1
        p[two == 1] = q
        at[simple] = p
    rest = np.setdiff1d(np.arange(lanes), simple, assume_unique=True)
    if not len(rest):
        return out
    p = at[rest]
    count = 4 + bits.take(p, 4)
    meta = np.zeros((len(rest), 19), np.int64)
    for i, symbol in enumerate(LENGTH_ORDER):
        more = np.flatnonzero(count > i)
        if not len(more):
            break
        q = p[more]
        meta[more, symbol] = bits.take(q, 3)
        p[more] = q
    codes = Codes(meta)
    left = np.full(len(rest), n)
    limited = np.flatnonzero(bits.take(p, 1))
    if len(limited):
        q = p[limited]
        wide = 2 + 2 * bits.take(q, 3)
        left[limited] = 2 + bits.take(q, wide)
        p[limited] = q
    lane, place, before = np.arange(len(rest)), np.zeros(len(rest), np.int64), np.full(len(rest), 8)
    while True:
        on = np.flatnonzero((place[lane] < n) & (left[lane] > 0))
        lane = lane[on]
        if not len(lane):
            break
        q = p[lane]
        symbol = codes.read(bits, q, lane)
        left[lane] -= 1
        plain = symbol < 16
        out[rest[lane[plain]], place[lane[plain]]] = symbol[plain]
        set_ = plain & (symbol > 0)
        before[lane[set_]] = symbol[set_]
        run = np.ones(len(lane), np.int64)
        runs = np.flatnonzero(~plain)
        if len(runs):
            s = symbol[runs]
            q2 = q[runs]
            run[runs] = np.where(s == 18, 11, 3) + bits.take(q2, np.where(s == 16, 2, np.where(s == 17, 3, 7)))
            q[runs] = q2
            for i in runs[s == 16]:
                out[rest[lane[i]], place[lane[i]] : place[lane[i]] + run[i]] = before[lane[i]]
        p[lane] = q
        place[lane] += run
    if (place > n).any():
        raise WebPError("code lengths run over their alphabet")
    at[rest] = p
    return out


# ---------------------------------------------------------------- entropy-coded images


def _value(bits: Bits, at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths and distances from their prefix symbols and extra bits."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + bits.take(at, extra) + 1


def _images(bits: Bits, at: np.ndarray, ends: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of one entropy-coded image for every position, joined, and where each begins; positions move on. An image that reads beyond its file's end is an error at once."""
    lanes = len(at)
    cache_bits = bits.take(at, 1)
    cached = np.flatnonzero(cache_bits)
    p = at[cached]
    cache_bits[cached] = bits.take(p, 4)
    at[cached] = p
    if len(cached) and not ((cache_bits[cached] >= 1) & (cache_bits[cached] <= 11)).all():
        raise WebPError("colour cache bits")

    # Groups of five prefix codes: one, or as many as an image of group numbers names.
    groups, shift = np.ones(lanes, np.int64), np.zeros(lanes, np.int64)
    maps: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(bits.take(at, 1)) if main else ():
        q = at[i : i + 1]
        shift[i] = 2 + int(bits.take(q, 3)[0])
        size = 1 << shift[i]
        maps[i], _ = _images(bits, q, ends[i : i + 1], -(-width[i : i + 1] // size), -(-height[i : i + 1] // size), False)
        maps[i] = ((maps[i] >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
        groups[i] = maps[i].max() + 1
    first_group = np.concatenate(([0], np.cumsum(groups)))[:-1]
    sizes = GREENS + LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0)
    n_groups = int(groups.sum())
    tables = [np.zeros((n_groups, k), np.int64) for k in (int(sizes.max(initial=0)), 256, 256, 256, DISTANCES)]
    for g in range(int(groups.max(initial=0))):
        some = np.flatnonzero(groups > g)
        for k in range(5):
            if (at > ends).any():
                raise WebPError("the data end too early")
            for n in np.unique(sizes[some]) if k == 0 else [tables[k].shape[1]]:
                own = some[sizes[some] == n] if k == 0 else some
                q = at[own]
                tables[k][first_group[own] + g, :n] = _read_lengths(bits, q, int(n))
                at[own] = q
    green, red, blue, alpha, distance = map(Codes, tables)
    plain_alpha = bool(alpha.trivial.all())

    total = width * height
    first = np.concatenate(([0], np.cumsum(total)))
    out = np.zeros(int(first[-1]), np.uint32)
    cache_first = np.concatenate(([0], np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0))))[:-1]
    cache = np.zeros(int(np.where(cache_bits > 0, 1 << cache_bits, 0).sum()) + 1, np.uint32)
    all_cached = bool((cache_bits > 0).all())

    stop = first[1:]
    here = first[:-1].copy()
    many_groups = bool(maps)
    # Images of a single literal colour take no bits at all.
    flat = (groups == 1) & green.trivial[first_group] & red.trivial[first_group] & blue.trivial[first_group] & alpha.trivial[first_group]
    for i in np.flatnonzero(flat):
        g, r, b, a = (int(c.table[c.first[first_group[i]]]) >> 4 for c in (green, red, blue, alpha))
        if g < GREENS:
            out[first[i] : first[i + 1]] = a << 24 | r << 16 | g << 8 | b
            here[i] = stop[i]

    def tables_of(code: np.ndarray) -> list[np.ndarray]:
        return [code, green.first[code], green.drop[code], red.first[code], red.drop[code], blue.first[code], blue.drop[code], alpha.table[alpha.first[code]] >> 4 << 24]

    # What each lane that goes on needs, so that a step gathers nothing but its symbols.
    words, low = bits.words.view("<i8"), (1 << 15) - 1
    lane, where = np.arange(lanes), at.copy()
    fixed = [lane, stop, ends, (32 - cache_bits).astype(np.uint32), cache_first, *tables_of(first_group)]
    while len(lane):
        if (where > fixed[2]).any():
            raise WebPError("the data end too early")
        on = here < fixed[1]
        if not on.all():
            done = lane[~on]
            at[done] = where[~on]
            where, here = where[on], here[on]
            fixed = [v[on] for v in fixed]
            lane = fixed[0]
            if not len(lane):
                break
        _, _, _, cb, cf, code, green_first, green_drop, red_first, red_drop, blue_first, blue_drop, opaque = fixed
        if many_groups:
            code = first_group[lane]
            for j, i in enumerate(lane):
                if i in maps:
                    k = here[j] - first[i]
                    code[j] += maps[i][(k // width[i] >> shift[i]) * -(-width[i] // (1 << shift[i])) + (k % width[i] >> shift[i])]
            code, green_first, green_drop, red_first, red_drop, blue_first, blue_drop, opaque = tables_of(code)
        # Green, red and blue have 45 bits at most: one look at the bits serves all three. What isn't a literal reads red and blue in vain.
        ahead = words[where >> 3] >> (where & 7)
        g = green.table.take(green_first + (REVERSED.take(ahead & low) >> green_drop))
        n = g & 15
        symbol = g >> 4
        ahead >>= n
        where += n
        r = red.table.take(red_first + (REVERSED.take(ahead & low) >> red_drop))
        n = r & 15
        ahead >>= n
        b = blue.table.take(blue_first + (REVERSED.take(ahead & low) >> blue_drop))
        n += b & 15
        px = r >> 4 << 16
        px |= symbol << 8
        px |= b >> 4
        literal = symbol < GREENS
        if plain_alpha:
            px |= opaque
        else:
            past = where + n
            a = alpha.table.take(alpha.first[code] + (REVERSED.take(words[past >> 3] >> (past & 7) & low) >> alpha.drop[code]))
            n += a & 15
            px |= a >> 4 << 24
        px = px.view(np.uint32)
        moved, copies = 1, None
        if literal.all():
            where += n
        else:
            where += n * literal
            c_ = np.flatnonzero(symbol >= GREENS + LENGTHS)
            px[c_] = cache[cf[c_] + symbol[c_] - GREENS - LENGTHS]
            if len(c_) + np.count_nonzero(literal) < len(lane):
                copies = ~literal & (symbol < GREENS + LENGTHS)
        if copies is None:
            out[here] = px
            kept = slice(None) if all_cached else np.flatnonzero(cb < 32) if len(cached) else None
        else:
            b_, rest = np.flatnonzero(copies), np.flatnonzero(~copies)
            out[here[rest]] = px[rest]
            kept = rest if all_cached else rest[cb[rest] < 32]
            moved = np.ones(len(lane), np.int64)
            q = where[b_]
            length = _value(bits, q, symbol[b_].astype(np.int64) - GREENS)
            far = _value(bits, q, distance.read(bits, q, code[b_]))
            where[b_] = q
            w = width[lane[b_]]
            near = far <= len(NEIGHBOURS)
            xy = NEIGHBOURS[np.where(near, far, 1) - 1]
            far = np.where(near, np.maximum(1, xy[:, 0] + xy[:, 1] * w), far - len(NEIGHBOURS))
            for j, n, d in zip(b_, length, far):
                i, a = lane[j], int(here[j])
                n, d = min(int(n), int(stop[i]) - a), int(d)
                if d > a - first[i]:
                    raise WebPError("a back-reference to before the image")
                if d >= n:
                    out[a : a + n] = out[a - d : a - d + n]
                else:
                    out[a : a + n] = np.resize(out[a - d : a], n)
                if cache_bits[i]:
                    some = out[a : a + n]
                    cache[cache_first[i] + ((some * CACHE_FACTOR) >> np.uint32(32 - cache_bits[i])).astype(np.int64)] = some
                moved[j] = n
        if kept is not None:
            px = px[kept]
            cache[cf[kept] + ((px * CACHE_FACTOR) >> cb[kept])] = px
        here = here + moved
    if (at > ends).any():
        raise WebPError("the data end too early")
    return out, first


# ---------------------------------------------------------------- transforms


def _planes(px: np.ndarray) -> np.ndarray:
    """[..., 4] channels, blue first."""
    return np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(*px.shape, 4)


def _packed(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.astype(np.uint8)).view("<u4")[..., 0]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pixels from their neighbours, as channels in wider integers."""
    average = lambda a, b: (a + b) >> 1
    if mode == 11:
        d_left, d_top = (np.abs(a - corner).sum(axis=-1, keepdims=True) for a in (top, left))
        return np.where(d_left < d_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = average(left, top)
        half = a - corner
        return np.clip(a + np.sign(half) * (np.abs(half) >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: average(average(left, right), top), 6: lambda: average(left, corner),
        7: lambda: average(left, top), 8: lambda: average(corner, top), 9: lambda: average(top, right), 10: lambda: average(average(left, corner), average(top, right)),
    }.get(mode, lambda: np.broadcast_to(np.array([0, 0, 0, 255]), left.shape))()


def predictor(px: np.ndarray, w: int, modes: np.ndarray, shift: int, invert: bool) -> np.ndarray:
    """Add (or, to encode, subtract) each pixel's prediction.

    Pixels with equal x + 2 y need only pixels of smaller such sums, so they are done together. The first pixel is predicted as opaque black, the first row from the
    left, the first column from above; the last column's top right is the next pixel in memory, its own row's first.
    """
    if invert and len(modes) and (modes == modes[0]).all() and modes[0] in (1, 2):
        # From the left or from above only: sums along rows and columns.
        p = _planes(px).reshape(-1, w, 4).copy()
        p[0, 0, 3] += np.uint8(255)
        along = 1 if modes[0] == 1 else 0
        edge = p[:, :1] if along else p[:1]
        edge[...] = np.cumsum(edge, axis=1 - along, dtype=np.uint8)
        return _packed(np.cumsum(p, axis=along, dtype=np.uint8).reshape(-1, 4))
    source = _planes(px).astype(np.int64)
    out = source.copy()
    ref, sign, h = (out, 1, len(px) // w) if invert else (source, -1, len(px) // w)
    y, x = np.divmod(np.arange(len(px)), w)
    mode = modes[(y >> shift) * -(-w // (1 << shift)) + (x >> shift)].astype(np.int64)
    mode[y == 0], mode[x == 0] = 1, 2
    mode[:1] = 0
    for t in range(w + 2 * h - 2):
        rows = np.arange(max(0, -(-(t - w + 1) // 2)), min(h - 1, t // 2) + 1)
        k = rows * w + t - 2 * rows
        own = mode[k]
        for m in np.unique(own):
            i = k[own == m]
            left, top, corner, right = (ref[np.maximum(0, i - d)] for d in (1, w, w + 1, w - 1))
            out[i] = (source[i] + sign * _predict(int(m), left, top, corner, right)) & 255
    return _packed(out)


def cross_colour(px: np.ndarray, w: int, elements: np.ndarray, shift: int, invert: bool) -> np.ndarray:
    """Add (or subtract) shares of green to red and of green and red to blue, by blocks."""
    y, x = np.divmod(np.arange(len(px)), w)
    e = _planes(elements)[(y >> shift) * -(-w // (1 << shift)) + (x >> shift)].view(np.int8).astype(np.int64)
    p = _planes(px).astype(np.int64)
    signed = lambda c: ((c & 255) ^ 128) - 128
    delta = lambda t, c: (t * signed(c)) >> 5
    green, sign = p[:, 1], 1 if invert else -1
    red = p[:, 2] + sign * delta(e[:, 0], green)
    blue = p[:, 0] + sign * (delta(e[:, 1], green) + delta(e[:, 2], red if invert else p[:, 2]))
    return _packed(np.stack((blue & 255, green, red & 255, p[:, 3]), axis=1))


def subtract_green(px: np.ndarray, invert: bool) -> np.ndarray:
    p = _planes(px).astype(np.int64)
    p[:, [0, 2]] = (p[:, [0, 2]] + (1 if invert else -1) * p[:, 1:2]) & 255
    return _packed(p)


def _bundle(colours: int) -> int:
    """Log 2 of how many indices share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unindex(px: np.ndarray, w: int, h: int, palette: np.ndarray) -> np.ndarray:
    """Pixels from palette indices in the green channel, several to a pixel for small palettes."""
    b = _bundle(len(palette))
    n, wide = 8 >> b, -(-w // (1 << b))
    green = ((px >> np.uint32(8)) & np.uint32(255)).astype(np.int64).reshape(h, wide)
    index = (green[:, :, None] >> (np.arange(1 << b) * n)) & ((1 << n) - 1)
    index = index.reshape(h, -1)[:, :w].ravel()
    return np.concatenate((palette, np.zeros(256, np.uint32)))[index]


# ---------------------------------------------------------------- decoding


def _simple(file: bytes) -> bytes:
    """A file as it is, or the still lossless image of one in the extended container, whose other chunks (colour profile, metadata) don't bear on pixels."""
    if file[8:16] != b"WEBPVP8X":
        return file
    if len(file) < 30:
        raise WebPError("the data end too early")
    canvas = [1 + int.from_bytes(file[i : i + 3], "little") for i in (24, 27)]
    at, end = 12, min(len(file), 8 + struct.unpack_from("<I", file, 4)[0])
    while at + 8 <= end:
        tag, n = struct.unpack_from("<4sI", file, at)
        if tag in (b"ANIM", b"ANMF", b"VP8 ", b"ALPH"):
            raise WebPError("not a still lossless image")
        if tag == b"VP8L":
            body = file[at + 8 : at + 8 + n]
            if len(body) < 5:
                raise WebPError("the data end too early")
            sides = int.from_bytes(body[1:5], "little")
            if [1 + (sides & 0x3FFF), 1 + (sides >> 14 & 0x3FFF)] != canvas:
                raise WebPError("the image isn't of its canvas's size")
            return struct.pack("<4sI8sI", b"RIFF", 12 + len(body) + (len(body) & 1), b"WEBPVP8L", len(body)) + body + b"\0" * (len(body) & 1)
        at += 8 + n + (n & 1)
    raise WebPError("no image in the container")


def decode(files: list[bytes], most_pixels: int = MOST_PIXELS) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, pixels) of lossless WebP files, in the simple or the extended container; pixels are ARGB by rows. A file that claims more than ``most_pixels`` is an error."""
    if not files:
        return []
    files = [_simple(f) for f in files]
    offset = np.concatenate(([0], np.cumsum([len(f) for f in files])))
    bits = Bits(np.frombuffer(b"".join(files), np.uint8))
    for f in files:
        if len(f) < 26 or f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != 0x2F:
            raise WebPError("not a lossless WebP file")
    at = (offset[:-1] + 21) * 8
    width, height = bits.take(at, 14) + 1, bits.take(at, 14) + 1
    ends = offset[1:] * 8
    if (width * height > most_pixels).any():
        raise WebPError(f"more than {most_pixels} pixels")
    bits.take(at, 1)
    if bits.take(at, 3).any():
        raise WebPError("an unknown version")
    undo: dict[int, list] = {}
    coded = width.copy()
    while True:
        if (at > ends).any():
            raise WebPError("the data end too early")
        more = np.flatnonzero(bits.take(at, 1))
        if not len(more):
            break
        # Lanes without a further transform stand at their image already; step back for the others' next turn.
        done = np.setdiff1d(np.arange(len(files)), more, assume_unique=True)
        at[done] -= 1
        q = at[more]
        kinds = bits.take(q, 2)
        at[more] = q
        for kind in range(4):
            own = more[kinds == kind]
            if not len(own):
                continue
            if any(kind == k for i in own for k, *_ in undo.get(int(i), [])):
                raise WebPError("a transform comes twice")
            q = at[own]
            wide = coded[own]
            parts: list[tuple] = [()] * len(own)
            if kind in (PREDICTOR, CROSS_COLOUR):
                shift = 2 + bits.take(q, 3)
                size = 1 << shift
                data, begin = _images(bits, q, ends[own], -(-wide // size), -(-height[own] // size), False)
                parts = [(data[begin[j] : begin[j + 1]], int(shift[j])) for j in range(len(own))]
            elif kind == COLOUR_INDEXING:
                n = bits.take(q, 8) + 1
                data, begin = _images(bits, q, ends[own], n, np.ones(len(own), np.int64), False)
                parts = [(_packed(np.cumsum(_planes(data[begin[j] : begin[j + 1]]), axis=0, dtype=np.uint8)),) for j in range(len(own))]
                coded[own] = [-(-w // (1 << _bundle(int(c)))) for w, c in zip(wide, n)]
            at[own] = q
            for i, w, part in zip(own, wide, parts):
                undo.setdefault(int(i), []).append((kind, int(w), *part))
    px, first = _images(bits, at, ends, coded, height, True)
    out = []
    for i in range(len(files)):
        own = px[first[i] : first[i + 1]]
        for kind, w, *rest in reversed(undo.get(i, [])):
            if kind == PREDICTOR:
                own = predictor(own, w, (rest[0] >> np.uint32(8)) & np.uint32(15), rest[1], True)
            elif kind == CROSS_COLOUR:
                own = cross_colour(own, w, rest[0], rest[1], True)
            elif kind == SUBTRACT_GREEN:
                own = subtract_green(own, True)
            else:
                own = unindex(own, w, int(height[i]), rest[0])
        out.append((int(width[i]), int(height[i]), own))
    return out


# ---------------------------------------------------------------- encoding

CACHE_BITS, LONGEST = 8, 11
#: Lengths of the code that codes code lengths: the encoder's lengths go up to 11, zeros come in runs.
META = np.array([3, *[4] * 11, 0, 0, 0, 0, 0, 4, 3])


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of their bits in the stream, for each row of code lengths."""
    counts = np.stack([(lengths == n).sum(axis=1) for n in range(LONGEST + 1)], axis=1)
    counts[:, 0] = 0
    code, out = np.zeros(len(lengths), np.int64), np.zeros(lengths.shape, np.int64)
    for n in range(1, LONGEST + 1):
        code = (code + counts[:, n - 1]) << 1
        is_n = lengths == n
        out += np.where(is_n, code[:, None] + np.cumsum(is_n, axis=1) - 1, 0)
    return np.where(lengths > 0, REVERSED[np.minimum(out << (15 - lengths), 32767)], 0)


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of complete prefix codes of at most 11 bits, for each row of counts with two symbols or more.

    Lengths begin as each symbol's information, rounded up; the room that is left goes to shorter codes, frequent symbols first.
    """
    used = counts > 0
    total = counts.sum(axis=1, keepdims=True)
    smooth = counts + total / 1500
    share = np.where(used, smooth, 0)
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
    lengths = np.where(used, np.clip(np.ceil(-np.log2(np.maximum(share, 1e-9)) - 1e-9), 1, LONGEST), 0).astype(np.int64)
    room = (1 << LONGEST) - np.where(used, 1 << (LONGEST - lengths), 0).sum(axis=1)
    order = np.argsort(-counts, axis=1, kind="stable")[:, : int(used.sum(axis=1).max(initial=0))]
    # By rank and row; unused symbols and lengths of 1 get no shorter.
    now = np.ascontiguousarray(np.take_along_axis(lengths, order, 1).T)
    gains = np.array([1 << 20, 1 << 20, *(1 << (LONGEST - n) for n in range(2, LONGEST + 1))])
    while (room > 0).any():
        for at_rank in now:
            gain = gains.take(at_rank)
            yes = gain <= room
            at_rank -= yes
            room -= gain * yes
    np.put_along_axis(lengths, order, now.T, 1)
    return lengths


def _put(words: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Or values of at most 57 bits into a bit string, at ascending positions; ``words`` are 32 bits in 64."""
    word, value = at >> 5, value.astype(np.uint64)
    low = (at & 31).astype(np.uint64)
    parts = ((value << low) & np.uint64(0xFFFFFFFF), (value >> (np.uint64(32) - low)) & np.uint64(0xFFFFFFFF), np.where(low > 0, value >> np.minimum(np.uint64(64) - low, np.uint64(63)), np.uint64(0)))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    for i, part in enumerate(parts):
        words[word[first] + i] |= np.bitwise_or.reduceat(part, first)


def _length_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) of the tokens of code lengths, row by row: plain lengths, and runs of 11 to 138 zeros where there are as many."""
    codes = _canonical(META[None, :])[0]
    rows, n = lengths.shape
    flat = lengths.ravel()
    column = np.tile(np.arange(n), rows)
    zero = flat == 0
    begins = zero & ((column == 0) | np.concatenate(([True], ~zero[:-1])))
    start = np.flatnonzero(begins)
    ends = zero & ((column == n - 1) | np.concatenate((~zero[1:], [True])))
    run = np.zeros(rows * n, np.int64)
    run[start] = np.flatnonzero(ends) + 1 - start
    since = np.arange(rows * n) - np.maximum.accumulate(np.where(begins, np.arange(rows * n), 0))
    length = np.where(zero, run[np.maximum.accumulate(np.where(begins, np.arange(rows * n), 0))], 0)
    # A zero run is cut in runs of 138; what is left of under 11 zeros is plain.
    head = zero & (since % 138 == 0) & (length - since >= 11)
    inside = zero & ((since // 138 * 138 + 11) <= length) & ~head
    some = np.flatnonzero(~inside)
    many = np.minimum(138, length - since)[some]
    h = head[some]
    value = np.where(h, codes[18] | (many - 11) << META[18], codes[np.where(h, 0, flat[some])])
    size = np.where(h, META[18] + 7, META[np.where(h, 0, flat[some])])
    return some // n, value, size


def _entropy_coded(argb: np.ndarray, total: np.ndarray, main: bool, alpha: int) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], None], np.ndarray]:
    """Bits of one entropy-coded image for each count of pixels, what writes them into words from given places on, and how many pixels are literals.

    Pixels of main images have one alpha, and are literals, hits in a colour cache of 256, or runs of the pixel before as back-references. Others (palettes) are literals;
    their first pixel is opaque, the rest have no alpha.
    """
    images = len(total)
    first = np.concatenate(([0], np.cumsum(total)))
    image = np.repeat(np.arange(images), total)
    k = np.arange(len(argb))
    symbol = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    extra, extra_bits = np.zeros(len(argb), np.int64), np.zeros(len(argb), np.int64)
    if main:
        same = np.concatenate(([False], argb[1:] == argb[:-1]))
        same[first[:-1]] = False
        begins = same & ~np.concatenate(([False], same[:-1]))
        ends = same & ~np.concatenate((same[1:], [False]))
        start, run = np.flatnonzero(begins), np.flatnonzero(ends) + 1 - np.flatnonzero(begins)
        start, run = start[run >= 3], run[run >= 3]
        covered = np.zeros(len(argb) + 1, np.int64)
        covered[start] += 1
        covered[start + run] -= 1
        covered = np.cumsum(covered)[:-1] > 0

        slot = ((argb * CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
        by = np.argsort(image * (1 << CACHE_BITS) + slot, kind="stable")
        key = (image * (1 << CACHE_BITS) + slot)[by]
        hit = np.zeros(len(argb), bool)
        hit[by[1:]] = (key[1:] == key[:-1]) & (argb[by[1:]] == argb[by[:-1]])

        symbol = np.where(hit, GREENS + LENGTHS + slot, symbol)
        step = run - 1
        e = np.maximum(0, np.frexp(np.maximum(step, 1))[1] - 2)
        prefix = np.where(step < 4, step, 2 * e + 2 + ((step >> e) & 1))
        symbol[start] = GREENS + prefix
        extra[start], extra_bits[start] = np.where(step < 4, 0, step - ((2 + (prefix & 1)) << e)), np.where(step < 4, 0, e)
        kept = np.sort(np.concatenate((np.flatnonzero(~covered), start)))
        image, symbol, k, extra, extra_bits = image[kept], symbol[kept], k[kept], extra[kept], extra_bits[kept]
    literal = symbol < GREENS
    red, blue = (argb[k] >> np.uint32(16) & np.uint32(255)).astype(np.int64), (argb[k] & np.uint32(255)).astype(np.int64)

    alphabets = (GREENS + LENGTHS + (main << CACHE_BITS), 256, 256)
    used = ((image, symbol), (image[literal], red[literal]), (image[literal], blue[literal]))
    counts = [np.bincount(i * n + s, minlength=images * n).reshape(images, n) for n, (i, s) in zip(alphabets, used)]
    lengths, codes, tokens = [], [], []
    meta_bits = sum(int(META[s]) << (3 * i) for i, s in enumerate(LENGTH_ORDER))
    for j, c in enumerate(counts):
        # A simple code names one symbol below 256; a green code of one other symbol is written in full, with a second one.
        c[c.sum(axis=1) == 0, 0] = 1
        one = c.argmax(axis=1)
        single = (c > 0).sum(axis=1) == 1
        if j == 0:
            lone = single & (one > 255)
            c[lone, 0], single = 1, single & ~lone
        n = np.zeros(c.shape, np.int64)
        if (~single).any():
            n[~single] = _code_lengths(c[~single])
        lengths.append(n)
        codes.append(_canonical(n))
        row, value, size = _length_tokens(n[~single]) if (~single).any() else (np.zeros(0, np.int64),) * 3
        tokens.append((single, one, np.flatnonzero(~single)[row] if len(row) else row, value, size))

    # Bit sizes of all parts, then their places.
    at = np.full(images, 6 if main else 1)  # the cache, and (of main images) one group
    places = []
    for single, _, row, _, size in tokens:
        places.append(at.copy())
        at += np.where(single, 11, 1 + 4 + 57 + 1) + np.bincount(row, size, images).astype(np.int64)
    tail = at.copy()  # the alpha and distance codes
    both = (total > 1) & (not main)
    at += np.where(both, 19, 11) + 11
    faded = both[image]
    pixel_bits = lengths[0][image, symbol] + np.where(literal, lengths[1][image, red] + lengths[2][image, blue] + faded, extra_bits)
    body = at.copy()
    at = at + np.bincount(image, pixel_bits, images).astype(np.int64)

    def write(words: np.ndarray, bit: np.ndarray) -> None:
        _put(words, bit, np.full(images, main | CACHE_BITS * main << 1))
        for (single, one, row, value, bits_), place in zip(tokens, places):
            where = bit + place
            if single.any():
                _put(words, where[single], 1 | 1 << 2 | one[single] << 3)
            if len(row):
                _put(words, where[~single], np.full(int((~single).sum()), 15 << 1))
                _put(words, where[~single] + 5, np.full(int((~single).sum()), meta_bits))
                before = np.cumsum(bits_) - bits_
                at_row = np.searchsorted(row, row)
                _put(words, where[row] + 63 + before - before[at_row], value)
        no_distance = 1 | 1 << 2 | 1 << 3
        _put(words, bit + tail, np.where(both, (1 | 1 << 1 | 1 << 2 | 255 << 11) | no_distance << 19, (1 | 1 << 2 | alpha << 3) | no_distance << 11))
        before = np.cumsum(pixel_bits) - pixel_bits
        at_image = np.searchsorted(image, np.arange(images))
        g, r, b = lengths[0][image, symbol], lengths[1][image, red], lengths[2][image, blue]
        opaque = (k == first[image]) & faded
        coded = codes[1][image, red] | codes[2][image, blue] << r | opaque << (r + b)
        _put(words, (bit + body)[image] + before - before[at_image][image], codes[0][image, symbol] | np.where(literal, coded, extra) << g)

    return at, write, np.bincount(image[literal], minlength=images)


def _files(argb: np.ndarray, total: np.ndarray, width: int, rows: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]] = [], palette=None, alpha: int = 255) -> tuple[list[bytes], np.ndarray]:
    """Whole files of coded main images, and how many of their pixels are literals. ``steps`` are transforms of one block: (6 bits of head, its pixel), of all images; ``palette`` is (colours, how many for each image)."""
    images = len(total)
    at = np.full(images, 40)
    if palette is not None:
        inner, put_palette, _ = _entropy_coded(*palette, False, 255)
        at += 11 + inner
    at += 62 * len(steps) + 1
    bits, put_main, literals = _entropy_coded(argb, total, True, alpha)
    size = -(-(at + bits) // 8)
    whole = 20 + size + (size & 1)
    begin = np.concatenate(([0], np.cumsum(whole)))
    words = np.zeros(int(begin[-1]) // 4 + 4, np.uint64)
    bit = (begin[:-1] + 20) * 8
    _put(words, bit, np.full(images, 0x2F) | (width - 1) << 8 | (rows - 1) << 22)
    if palette is not None:
        _put(words, bit + 40, 1 | COLOUR_INDEXING << 1 | (palette[1] - 1) << 3)
        put_palette(words, bit + 51)
    for i, (head, pixel) in enumerate(steps):
        _put(words, bit + 40 + 62 * i, head)
        # No cache, then codes of one symbol each: green, red, blue, opaque, and no distance.
        blue, green, red = (pixel >> s & 255 for s in (0, 8, 16))
        code = lambda v: 5 | v << 3
        _put(words, bit + 47 + 62 * i, code(green) | code(red) << 11 | code(blue) << 22 | code(255) << 33)
        _put(words, bit + 91 + 62 * i, np.full(images, code(0)))
    put_main(words, bit + at)
    raw = words.astype("<u4").tobytes()
    out = []
    for i in range(images):
        n, a = int(size[i]), int(begin[i])
        out.append(struct.pack("<4sI8sI", b"RIFF", int(whole[i]) - 8, b"WEBPVP8L", n) + raw[a + 20 : a + int(whole[i])])
    return out, literals


#: Predictor modes and shares of green (32 is all) that the encoder tries, and the most colours of a palette.
MODES, SHARES, COLOURS = (1, 2), (16, 32), 256
#: Every third pixel tells what a transform is worth; palettes are tried where colours are literals this many times.
SAMPLE, TIMES = 3, 1.25
LOG2 = np.log2(np.maximum(np.arange(1 << 14), 1))


def _residuals(p: np.ndarray, k: np.ndarray, width: int, top_row: np.ndarray, mode: int) -> np.ndarray:
    """What a predictor (none, left or above) leaves of pixels ``k`` of [n, 3]; ``top_row`` marks those in an image's first row."""
    if not mode:
        return p[k]
    edge = k % width == 0
    back = np.where(top_row, 1, np.where(edge, width, width if mode == 2 else 1))
    before = p[np.maximum(0, k - back)]
    before[top_row & edge] = 0
    return p[k] - before


def _less_green(p: np.ndarray, share: int) -> np.ndarray:
    """Pixels (red, green, blue) without shares of green in red and blue."""
    delta = (share * p[:, 1].astype(np.int8).astype(np.int16) >> 5).astype(np.uint8)
    return np.stack((p[:, 0] - delta, p[:, 1], p[:, 2] - delta), axis=1)


def _information(p: np.ndarray, image: np.ndarray, images: int) -> np.ndarray:
    """Bits of each image's pixels [n, 3] by the entropy of their channels."""
    out = np.zeros(images)
    for c in range(3):
        n = np.bincount(image << 8 | p[:, c], minlength=images << 8)
        total = n.reshape(images, 256).sum(axis=1)
        out += total * LOG2[np.minimum(total, len(LOG2) - 1)] - (n * LOG2[np.minimum(n, len(LOG2) - 1)]).reshape(images, 256).sum(axis=1)
    return out


def _of(chosen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The pixels of chosen images."""
    return np.repeat(chosen, total)


def _argb(p: np.ndarray, alpha: int) -> np.ndarray:
    q = p.astype(np.uint32)
    return np.uint32(alpha << 24) | q[:, 0] << np.uint32(16) | q[:, 1] << np.uint32(8) | q[:, 2]


def encode_payloads(data: np.ndarray, rows: np.ndarray, width: int) -> list[bytes]:
    """One lossless WebP file for each count of pixel rows, of three payload bytes (red, green, blue) a pixel.

    Every image is coded as it is; those of at most 256 colours that recur also by their palette, and those whose channels tell less after a predictor or without their
    share of green also by these transforms. The shortest file stays, the plainest of equal ones.
    """
    images = len(rows)
    if not images:
        return []
    p = data.reshape(-1, 3)
    argb = _argb(p, 255)
    total = rows * width
    image = np.repeat(np.arange(images), total)
    files, literals = _files(argb, total, width, rows)

    def keep(chosen: np.ndarray, other: list[bytes]) -> None:
        for i, f in zip(np.flatnonzero(chosen), other):
            if len(f) < len(files[i]):
                files[i] = f

    # Palettes. Small ones have several indices in a pixel.
    # A lower bound of the colours by 1,024 hashes saves the sort of most images.
    slots = np.bincount(image << 10 | ((argb * CACHE_FACTOR) >> np.uint32(22)), minlength=images << 10).reshape(images, 1024)
    few = (slots > 0).sum(axis=1) * TIMES <= np.minimum(literals, COLOURS * TIMES)
    own = _of(few, total)
    key = np.unique(image[own] << 32 | argb[own])
    colours = np.bincount(key >> 32, minlength=images)
    few &= (colours <= COLOURS) & (colours * TIMES <= literals)
    for bundle in range(4):
        some = few & (np.array([_bundle(n) for n in range(COLOURS + 1)])[np.minimum(colours, COLOURS)] == bundle)
        if not some.any():
            continue
        own = key[some[key >> 32]]
        at = np.concatenate(([0], np.cumsum(colours[some])))[:-1]
        number = np.cumsum(some) - 1
        index = np.searchsorted(own, image[_of(some, total)] << 32 | argb[_of(some, total)]) - at[number[image[_of(some, total)]]]
        each, bits = 1 << bundle, 8 >> bundle
        index = np.pad(index.reshape(-1, width), ((0, 0), (0, -width % each))).reshape(-1, each)
        packed = (index << (np.arange(each) * bits)).sum(axis=1)
        planes = _planes(own.astype(np.uint32))
        steps = planes - np.concatenate((np.zeros((1, 4), np.uint8), planes[:-1]))
        steps[at] = planes[at]
        main = BLACK | packed.astype(np.uint32) << np.uint32(8)
        keep(some, _files(main, rows[some] * -(-width // each), width, rows[some], palette=(_packed(steps), colours[some]))[0])

    # Predictor and cross-colour, of one block each.
    k = np.arange(len(p))
    within = k - np.repeat(np.cumsum(total) - total, total)
    top_row, some = within < width, np.flatnonzero(within % SAMPLE == 0)
    best, how = np.full(images, np.inf), np.zeros((images, 2), np.int64)
    for mode in (0, *MODES):
        q = _residuals(p, some, width, top_row[some], mode)
        for share in (0, *SHARES):
            cost = SAMPLE * _information(_less_green(q, share) if share else q, image[some], images) + 62 * ((mode > 0) + (share > 0))
            better = cost < best
            best[better], how[better] = cost[better], (mode, share)
    for mode, share in np.unique(how, axis=0).tolist():
        if not (mode or share):
            continue
        some = (how == (mode, share)).all(axis=1)
        own = _of(some, total)
        q = _residuals(p, k[own], width, top_row[own], mode)
        q = _less_green(q, share) if share else q
        n = np.ones(int(some.sum()), np.int64)
        steps = [(n * (1 | PREDICTOR << 1 | 7 << 3), n * (mode << 8))] if mode else []
        steps += [(n * (1 | CROSS_COLOUR << 1 | 7 << 3), n * (share << 8 | share))] if share else []
        alpha = 0 if mode else 255
        keep(some, _files(_argb(q, alpha), total[some], width, rows[some], steps, alpha=alpha)[0])
    return files
