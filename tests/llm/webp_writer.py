"""A plain bit writer of lossless WebP files for tests: one pixel at a time, with every transform."""

import struct

import numpy as np

from tidemark.llm import webp


class Writer:
    def __init__(self, w, h):
        self.w, self.h, self.bits = w, h, []
        self.put(0x2F, 8), self.put(w - 1, 14), self.put(h - 1, 14), self.put(1, 1), self.put(0, 3)

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def file(self):
        data = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        body = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body

    def flat_code(self, n, size):
        """A code of n symbols of equal length (a power of two of them), then none."""
        depth = n.bit_length() - 1
        self.put(0, 1), self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(1 if s in (depth, 0) else 0, 3)
        self.put(0, 1)
        zero, own = (0, 1) if depth else (0, 0)
        for i in range(size):
            self.put(own if i < n else zero, 1)
        return lambda s: [(s >> (depth - 1 - i)) & 1 for i in range(depth)]

    def one_code(self, symbol):
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbol, 8)

    def image(self, px, main, groups=None):
        """An image of literals: a flat code for each channel."""
        self.put(0, 1)
        if main:
            self.put(1 if groups else 0, 1)
            if groups:
                shift, numbers = groups
                self.put(shift - 2, 3)
                self.image((np.array(numbers, np.uint32) << 8) | np.uint32(0xFF000000), False)
        n_groups = max(groups[1]) + 1 if groups else 1
        for _ in range(n_groups):
            green = self.flat_code(256, 280)
            codes = [green] + [self.flat_code(256, 256) for _ in range(3)]
            self.one_code(0)
        for p in px.tolist():
            for code, shift_ in zip(codes, (8, 16, 0, 24)):
                self.bits += code((p >> shift_) & 255)
        return self

    def plain(self, px):
        self.put(0, 1)
        return self.image(px, True).file()

    def predictor(self, px, mode, shift):
        across, down = -(-self.w // (1 << shift)), -(-self.h // (1 << shift))
        modes = np.full(across * down, mode)
        self.put(1, 1), self.put(0, 2), self.put(shift - 2, 3)
        self.image((modes.astype(np.uint32) << 8) | np.uint32(0xFF000000), False)
        self.put(0, 1)
        return self.image(webp.predictor(px, self.w, modes, shift, False), True).file()

    def cross_colour(self, px, element, shift):
        n = -(-self.w // (1 << shift)) * -(-self.h // (1 << shift))
        elements = np.full(n, element | 0xFF000000, np.uint32)
        self.put(1, 1), self.put(1, 2), self.put(shift - 2, 3)
        self.image(elements, False)
        self.put(0, 1)
        return self.image(webp.cross_colour(px, self.w, elements, shift, False), True).file()

    def subtract_green(self, px):
        self.put(1, 1), self.put(2, 2), self.put(0, 1)
        return self.image(webp.subtract_green(px, False), True).file()

    def green_then_predictor(self, px, mode, shift):
        self.put(1, 1), self.put(2, 2)
        return self.predictor(webp.subtract_green(px, False), mode, shift)

    def palette(self, px):
        colours, index = np.unique(px, return_inverse=True)
        b = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        wide, n = -(-self.w // (1 << b)), 8 >> b
        rows = np.zeros((self.h, wide << b), np.int64)
        rows[:, : self.w] = index.reshape(self.h, self.w)
        packed = (rows.reshape(self.h, wide, 1 << b) << (np.arange(1 << b) * n)).sum(axis=2).ravel()
        steps = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
        steps = np.diff(steps, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).copy().view("<u4").ravel()
        self.put(1, 1), self.put(3, 2), self.put(len(colours) - 1, 8)
        self.image(steps, False)
        self.put(0, 1)
        return self.image((packed.astype(np.uint32) << 8) | np.uint32(0xFF000000), True).file()

    def references(self, px, distance, cache=0):
        """The first pixels as literals (or, again, from the cache), then one back-reference to them."""
        self.put(0, 1)
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        self.put(0, 1)
        size = 280 + (1 << cache if cache else 0)
        # 256 literals of nine bits fill half of the code; the other symbols share the rest.
        others = [i for i in range(256, size)]
        depth = {s: 9 for s in range(256)}
        k = (len(others) - 1).bit_length()
        for i, s in enumerate(others):
            depth[s] = 1 + k
        spare = (1 << k) - len(others)
        for s in others[: spare]:
            depth[s] -= 1
        self.lengths([depth.get(s, 0) for s in range(size)])
        green = canonical(depth)
        rest = [self.flat_code(256, 256) for _ in range(3)]
        raw = distance + 120
        prefix, extra, n_extra = prefix_of(raw)
        self.one_code(prefix)
        table = {}
        for p in px[:distance].tolist():
            slot = ((p * 0x1E35A7BD) & 0xFFFFFFFF) >> (32 - cache) if cache else None
            if cache and table.get(slot) == p:
                self.bits += green[280 + slot]
            else:
                for code, s in zip((lambda v: green[v], *rest), (8, 16, 0, 24)):
                    self.bits += code((p >> s) & 255)
            table[slot] = p
        length = len(px) - distance
        p, e, n = prefix_of(length)
        self.bits += green[256 + p]
        self.put(e, n)
        self.put(extra, n_extra)
        return self.file()

    def lengths(self, lengths):
        self.put(0, 1), self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.bits += [(n >> (3 - i)) & 1 for i in range(4)]

    def groups(self, px, shift):
        n = -(-self.w // (1 << shift)) * -(-self.h // (1 << shift))
        self.put(0, 1)
        return self.image(px, True, groups=(shift, [i % 3 for i in range(n)])).file()


def canonical(depth):
    out, code, last = {}, 0, 0
    for d, s in sorted((d, s) for s, d in depth.items()):
        code <<= d - last
        last = d
        out[s] = [(code >> (d - 1 - i)) & 1 for i in range(d)]
        code += 1
    return out


def prefix_of(value):
    v = value - 1
    if v < 4:
        return v, 0, 0
    e = v.bit_length() - 2
    return 2 * e + 2 + ((v >> e) & 1), v - ((2 + ((v >> e) & 1)) << e), e
