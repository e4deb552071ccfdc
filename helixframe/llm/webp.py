"""Lossless WebP (VP8L): pixel arrays to files and back, and a column of them.

``decode`` reads any VP8L stream: prefix codes in groups, back-references, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. ``encode`` writes each of these on
request. For columns of many small images both sides work on arrays: ``Codec`` finds back-references and
colour-cache hits of all images at once, and gives each the smaller of two streams, literals alone or
literals with cache and copies; images of few colours get the transforms that make them smallest.
``Reader`` reads streams without transforms in lockstep, one pixel of every image at a step; code tables
that were read before are recognised by their bits. All others go through ``decode``.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import utf8

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = 0x1E35A7BD
OPAQUE_BLACK = 0xFF000000


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = bytes(data) + bytes(8), at

    def peek(self) -> int:
        """At least 56 bits from here on."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > 8 * (len(self.data) - 8):
            raise ValueError("the stream ends early")
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


class Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


# ---- prefix codes


def huffman_lengths(weights: list[int], limit: int = 15) -> list[int]:
    """Code lengths for the symbols of positive weight; rarer ones are lifted until none exceeds ``limit``."""
    used = [s for s, w in enumerate(weights) if w > 0]
    if len(used) < 2:
        return [1 if s in used else 0 for s in range(len(weights))]
    floor = 1
    while True:
        heap = [(max(weights[s], floor), i, (s,)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        lengths, order = [0] * len(weights), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], order, a[2] + b[2]))
            order += 1
        if max(lengths) <= limit:
            return lengths
        floor *= 2


def canonical(lengths: list[int]) -> list[tuple[int, int]]:
    """(bits in stream order, length) of each symbol."""
    out, code, last = [(0, 0)] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


class Prefix:
    """A decoding table over as many bits as the longest code has; a lone symbol takes none."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            lengths, used = [1], [0]
        self.width = 0 if len(used) == 1 else max(lengths)
        self.symbols = np.full(1 << self.width, used[0], np.uint64)
        self.sizes = np.zeros(1 << self.width, np.uint64)
        if len(used) > 1:
            if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
                raise ValueError("the code lengths form no complete prefix code")
            for s, (code, n) in enumerate(canonical(lengths)):
                if n:
                    self.symbols[code :: 1 << n] = s
                    self.sizes[code :: 1 << n] = n
        self.table = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        self.mask = (1 << self.width) - 1

    def read(self, bits: Bits) -> int:
        symbol, size = self.table[bits.peek() & self.mask]
        bits.at += size
        return symbol


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    first = [0] * 19
    for s in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        first[s] = bits.read(3)
    outer = Prefix(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = outer.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        value, run = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + run > alphabet:
            raise ValueError("a run of code lengths goes too far")
        lengths[at : at + run] = [value] * run
        at += run
    return Prefix(lengths)


def write_prefix(out: Out, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(int(used[0] > 1), 1)
        out.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.write(used[1], 8)
        return
    tokens, i, last = [], 0, 8
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
        elif lengths[i] == last and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run, last = 1, lengths[i] or last
            tokens.append((lengths[i], 0, 0))
        i += run
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    outer = huffman_lengths(counts, 7)
    n = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if outer[s]))
    out.write(0, 1)
    out.write(n - 4, 4)
    for s in CODE_LENGTH_ORDER[:n]:
        out.write(outer[s], 3)
    out.write(0, 1)
    codes = canonical(outer) if sum(map(bool, outer)) > 1 else [(0, 0)] * 19
    for s, extra, n in tokens:
        out.write(*codes[s])
        out.write(extra, n)


# ---- reading


def prefix_value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_codes(bits: Bits, cache_bits: int) -> list[Prefix]:
    return [read_prefix(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image of ``width`` times ``height`` ARGB pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    tile, groups = 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups = (read_pixels(bits, -(-width // (1 << tile)), -(-height // (1 << tile)), False) >> 8) & 0xFFFF
        wide = -(-width // (1 << tile))
    codes = [read_codes(bits, cache_bits) for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    total, out, at = width * height, [0] * (width * height), 0
    cache, stale = [0] * (1 << cache_bits), 0
    green, red, blue, alpha, distance = codes[0]
    while at < total:
        if groups is not None:
            green, red, blue, alpha, distance = codes[groups[((at // width) >> tile) * wide + ((at % width) >> tile)]]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            run = prefix_value(bits, s - 256)
            far = prefix_value(bits, distance.read(bits))
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + run > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(run):
                out[at] = out[at - far]
                at += 1
        else:
            while stale < at:
                cache[(CACHE_FACTOR * out[stale] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[stale]
                stale += 1
            out[at] = cache[s - 280]
            at += 1
        if bits.at > 8 * (len(bits.data) - 8):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(pixel: int) -> tuple[int, int, int, int]:
    return pixel & 255, pixel >> 8 & 255, pixel >> 16 & 255, pixel >> 24


def _join(values) -> int:
    b, g, r, a = values
    return b | g << 8 | r << 16 | a << 24


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode in (0, 14, 15):
        return OPAQUE_BLACK
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode < 10:
        return _mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(top_left), strict=True))
        to_top = sum(abs(x - c) for x, c in zip(_channels(left), _channels(top_left), strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return _join(_clamp(x + t - c) for x, t, c in zip(_channels(left), _channels(top), _channels(top_left), strict=True))
    return _join(_clamp(m + int((m - c) / 2)) for m, c in zip(_channels(_mean(left, top)), _channels(top_left), strict=True))


def _predictions(pixels: list[int], width: int, height: int, tile: int, modes: np.ndarray, apply) -> None:
    """Call ``apply(at, prediction)`` for each pixel in order."""
    wide = -(-width // (1 << tile))
    modes = ((modes >> 8) & 15).tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if y == 0:
                p = pixels[at - 1] if x else OPAQUE_BLACK
            elif x == 0:
                p = pixels[at - width]
            else:  # right of the last column stands the first pixel of this row
                p = predict(modes[(y >> tile) * wide + (x >> tile)], pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])
            apply(at, p)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return _join((x - y) & 255 for x, y in zip(_channels(a), _channels(b), strict=True))


def undo_predictor(pixels: np.ndarray, width: int, height: int, tile: int, modes: np.ndarray) -> np.ndarray:
    out = pixels.tolist()

    def apply(at, p):
        out[at] = _add(out[at], p)

    _predictions(out, width, height, tile, modes, apply)
    return np.array(out, np.uint32)


def _cross(pixels: np.ndarray, width: int, height: int, tile: int, elements: np.ndarray, sign: int) -> np.ndarray:
    wide = -(-width // (1 << tile))
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[(y >> tile) * wide + (x >> tile)]

    def delta(t, c):
        return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5

    green, red, blue = (pixels >> 8) & 255, (pixels >> 16) & 255, pixels & 255
    new_red = (red.astype(np.int32) + sign * delta(e & 255, green)) & 255
    true_red = new_red if sign > 0 else red
    new_blue = (blue.astype(np.int32) + sign * (delta((e >> 8) & 255, green) + delta((e >> 16) & 255, np.asarray(true_red)))) & 255
    return (pixels & np.uint32(0xFF00FF00)) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = ((pixels >> 8) & 255).astype(np.int64)
    red, blue = ((((pixels >> s) & 255).astype(np.int64) + sign * green) & 255 for s in (16, 0))
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _bundle(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    shift = _bundle(len(palette))
    wide, size = -(-width // (1 << shift)), 8 >> shift
    y, x = np.divmod(np.arange(width * height), width)
    index = (pixels[y * wide + (x >> shift)] >> 8 & 255) >> (size * (x & ((1 << shift) - 1))).astype(np.uint32) & ((1 << size) - 1)
    table = np.zeros(256, np.uint32)  # an index past the palette is transparent black
    table[: len(palette)] = palette
    return table[index]


def bitstream(file: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], struct.unpack("<I", file[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(file: bytes) -> np.ndarray:
    """ARGB pixels of a lossless WebP file, as a height by width array of uint32."""
    bits = Bits(bitstream(file))
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            tile = bits.read(3) + 2
            blocks = read_pixels(bits, -(-wide // (1 << tile)), -(-height // (1 << tile)), False)
            undo.append((undo_predictor, (wide, height, tile, blocks)) if kind == PREDICTOR else (_cross, (wide, height, tile, blocks, 1)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_green, (1,)))
        else:
            steps = read_pixels(bits, bits.read(8) + 1, 1, False)
            palette = np.cumsum(steps.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            undo.append((undo_palette, (wide, height, palette)))
            wide = -(-wide // (1 << _bundle(len(palette))))
    pixels = read_pixels(bits, wide, height, True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return pixels.reshape(height, width)


# ---- writing


def _value_prefix(value: int) -> tuple[int, int, int]:
    """prefix_value backwards: prefix, extra bits, their number."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), value & ((1 << extra) - 1), extra


def write_pixels(out: Out, pixels: np.ndarray, width: int, height: int, main: bool, cache_bits: int = 0, copies: bool = False, group_tile: int = 0) -> None:
    """``copies``: replace repeats of 4 or more pixels; ``group_tile``: bits of the side of the blocks that alternate between two code groups."""
    values, n = pixels.tolist(), width * height
    steps, at, last, cache, stale = [], 0, {}, [None] * (1 << cache_bits), 0
    while at < n:
        key = tuple(values[at : at + 4])
        back = last.get(key) if copies and len(key) == 4 else None
        run = 0
        if back is not None:
            while at + run < n and run < 4096 and values[back + run] == values[at + run]:
                run += 1
        if run:
            distance = at - back
            near = next((i + 1 for i, (x, y) in enumerate(NEAR) if max(1, x + y * width) == distance), distance + len(NEAR))
            steps.append((at, 256, _value_prefix(run), _value_prefix(near)))
        else:
            run, pixel = 1, values[at]
            slot = (CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            steps.append((at, 280 + slot, None, None) if cache_bits and cache[slot] == pixel else (at, 0, pixel, None))
        for k in range(at, at + run):
            if copies:
                last[tuple(values[k : k + 4])] = k
            if cache_bits:
                cache[(CACHE_FACTOR * values[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[k]
        at += run
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    wide, groups = 1, 1
    if main:
        out.write(int(group_tile > 0), 1)
        if group_tile:
            wide, tall, groups = -(-width // (1 << group_tile)), -(-height // (1 << group_tile)), 2
            out.write(group_tile - 2, 3)
            write_pixels(out, np.array([OPAQUE_BLACK | (i % 2) << 8 for i in range(wide * tall)], np.uint32), wide, tall, False)

    def group(at):
        return (((at // width) >> group_tile) * wide + ((at % width) >> group_tile)) % 2 if group_tile else 0

    counts = [[[0] * k for k in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for at, kind, a, b in steps:
        c = counts[group(at)]
        if kind == 0:
            for k, s in zip((2, 0, 1, 3), _channels(a), strict=True):
                c[k][s] += 1
        elif kind == 256:
            c[0][256 + a[0]] += 1
            c[4][b[0]] += 1
        else:
            c[0][kind] += 1
    codes = []
    for c in counts:
        lengths = [huffman_lengths(x) for x in c]
        for x in lengths:
            write_prefix(out, x)
        codes.append([canonical(x) if sum(map(bool, x)) > 1 else [(0, 0)] * len(x) for x in lengths])
    for at, kind, a, b in steps:
        green, red, blue, alpha, distance = codes[group(at)]
        if kind == 0:
            blue_s, green_s, red_s, alpha_s = _channels(a)
            for code, s in ((green, green_s), (red, red_s), (blue, blue_s), (alpha, alpha_s)):
                out.write(*code[s])
        elif kind == 256:
            for code, (s, extra, k) in ((green, (256 + a[0], *a[1:])), (distance, b)):
                out.write(*code[s])
                out.write(extra, k)
        else:
            out.write(*green[kind])


def _file(stream: bytes) -> bytes:
    padded = stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, copies: bool = False, group_tile: int = 0, tile: int = 3, mode: int | None = None) -> bytes:
    """A lossless WebP file of a height by width array of ARGB pixels, with the transforms in the given order.

    ``mode``: one predictor for all blocks; without it block ``i`` uses predictor ``i % 14``.
    """
    height, width = pixels.shape
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise ValueError("an image has 1 to 16384 rows and columns")
    out = Out()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 4)  # alpha is used; version 0
    data, wide = np.ascontiguousarray(pixels, np.uint32).ravel(), width
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        blocks = -(-wide // (1 << tile)) * -(-height // (1 << tile))
        if kind == PREDICTOR:
            modes = np.array([OPAQUE_BLACK | (i % 14 if mode is None else mode) << 8 for i in range(blocks)], np.uint32)
            plain, coded = data.tolist(), data.tolist()

            def apply(at, p, plain=plain, coded=coded):
                coded[at] = _subtract(plain[at], p)

            _predictions(plain, wide, height, tile, modes, apply)
            data = np.array(coded, np.uint32)
        elif kind == CROSS_COLOR:
            modes = np.array([OPAQUE_BLACK | (7 * i + 3 & 255) << 16 | (5 * i + 250 & 255) << 8 | (11 * i + 9 & 255) for i in range(blocks)], np.uint32)
            data = _cross(data, wide, height, tile, modes, -1)
        elif kind == SUBTRACT_GREEN:
            data = _green(data, -1)
        else:
            palette, index = np.unique(data, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("a palette has at most 256 colours")
            out.write(len(palette) - 1, 8)
            steps = np.diff(palette.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            write_pixels(out, steps.view(np.uint32).ravel(), len(palette), 1, False)
            shift = _bundle(len(palette))
            size, narrow = 8 >> shift, -(-wide // (1 << shift))
            packed = np.zeros((height, narrow << shift), np.uint32)
            packed[:, :wide] = index.reshape(height, wide)
            packed = packed.reshape(height, narrow, 1 << shift) << (size * np.arange(1 << shift, dtype=np.uint32))
            data, wide = (packed.sum(axis=2, dtype=np.uint32) << np.uint32(8) | np.uint32(OPAQUE_BLACK)).ravel(), narrow
            continue
        if kind in (PREDICTOR, CROSS_COLOR):
            out.write(tile - 2, 3)
            write_pixels(out, modes, -(-wide // (1 << tile)), -(-height // (1 << tile)), False)
    out.write(0, 1)
    write_pixels(out, data, wide, height, True, cache_bits, copies, group_tile)
    return _file(out.value.to_bytes(-(-out.n // 8), "little"))


# ---- many images at once

WIDE, TALL = 16, 256  # a row of pixels holds 64 bytes, an image at most 16 KiB
LONGEST = 14  # four codes fit one 64-bit window
CACHE_BITS = 10
FEW = 16  # so many cache misses at most, and FEW_PIXELS at least, make an image worth trying transforms on
FEW_PIXELS = 64
TRIED = ((PALETTE,), (PREDICTOR,), (SUBTRACT_GREEN, PREDICTOR), (CROSS_COLOR, PREDICTOR), (PALETTE, PREDICTOR))
#: The distance code of each distance in an image WIDE pixels across: the first near place, else itself.
DISTANCE_CODE = np.arange(WIDE * TALL + 1) + len(NEAR)
for _code, (_x, _y) in reversed(list(enumerate(NEAR, 1))):
    DISTANCE_CODE[max(1, _x + _y * WIDE)] = _code


def _text_weights() -> list[int]:
    """Weights of byte values in prose: letters by their common order, capitals, signs and UTF-8 bytes by class."""
    weights = [1] * 256
    for rank, c in enumerate(b"etaoinsrhldcumfpgwybvkxjqz"):
        weights[c] = 2400 // (rank + 3)
        weights[c - 32] = max(2, 90 // (rank + 3))
    for c in range(0x21, 0x41):
        weights[c] = 4
    for c in range(0x80, 0xC0):
        weights[c] = 6
    weights[0], weights[0x0A], weights[0x20], weights[0x2C], weights[0x2E], weights[0xC3] = 12, 24, 1100, 60, 60, 150
    return weights


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_value_prefix of many values."""
    v = np.maximum(value - 1, 1).astype(np.uint64)
    extra = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 2, 0)
    far = value > 4
    prefix = np.where(far, 2 * extra + 2 + (v.astype(np.int64) >> extra & 1), value - 1)
    extra = np.where(far, extra, 0)
    return prefix, np.where(far, v.astype(np.int64) & ((1 << extra) - 1), 0), extra


class _Code:
    """Fixed prefix codes of the five alphabets, and the head of a stream that uses them."""

    def __init__(self, green: list[int], cache_bits: int, distance: list[int]):
        literal = huffman_lengths(_text_weights(), LONGEST)
        lengths = [huffman_lengths(green, LONGEST), literal, literal, literal, huffman_lengths(distance, LONGEST)]
        codes = [canonical(n) for n in lengths]
        self.code = [np.array([c for c, _ in x], np.uint64) for x in codes]
        self.size = [np.array(n, np.uint64) for n in lengths]
        out = Out()
        out.write(0, 1)  # no transform
        out.write(int(cache_bits > 0), 1)
        if cache_bits:
            out.write(cache_bits, 4)
        out.write(0, 1)  # one code group
        for n in lengths:
            write_prefix(out, n)
        self.head, self.head_bits = out.value, 40 + out.n


class Codec:
    """Many images at once; the same bytes always give the same file."""

    def __init__(self):
        prose = _text_weights()
        self.plain = _Code([*prose, *[0] * 24], 0, [0] * 40)
        total = sum(prose)
        # a third of the pixels from the cache, one in fifty starts a copy
        copies = [max(1, total // (40 * (k + 4))) for k in range(24)]
        self.rich = _Code([*prose, *copies, *[max(1, total // (2 << CACHE_BITS))] * (1 << CACHE_BITS)], CACHE_BITS, [2 + (k > 8) * 3 + (k > 14) * 5 for k in range(40)])

    @staticmethod
    def _literals(pixels: np.ndarray, code: _Code) -> tuple[np.ndarray, np.ndarray]:
        bits, size = np.zeros(len(pixels), np.uint64), np.zeros(len(pixels), np.uint64)
        for k, channel in enumerate((1, 2, 0, 3)):  # green, red, blue, alpha
            c = pixels[:, channel]
            bits |= code.code[k][c] << size
            size += code.size[k][c]
        return bits, size

    @staticmethod
    def repeats(pixels: np.ndarray, image: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which pixels the colour cache holds, each pixel's slot, and the copies: their lengths and distances, 0 elsewhere."""
        n = len(pixels)
        slot = (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)
        order = np.argsort(image << CACHE_BITS | slot.astype(np.int64), kind="stable")
        same = np.zeros(n, bool)
        a, b = order[:-1], order[1:]
        same[b] = (pixels[a] == pixels[b]) & (image[a] == image[b])
        length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n >= 4:
            wide = pixels.astype(np.uint64)
            key = (wide[:-3] | wide[1:-2] << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + (wide[2:-1] | wide[3:] << np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
            at = np.flatnonzero((image[:-3] == image[3:]) & same[:-3])  # a copy's first pixel was seen before
            order = at[np.argsort(key[at], kind="stable")]
            a, b = order[:-1], order[1:]
            equal = (image[a] == image[b]) & np.logical_and.reduce([pixels[a + k] == pixels[b + k] for k in range(4)])
            back = np.zeros(n, np.int64)
            back[b[equal]] = (b - a)[equal]
            here = np.flatnonzero(back)
            if len(here):
                new = np.flatnonzero(np.concatenate([[True], (np.diff(here) != 1) | (np.diff(back[here]) != 0)]))
                begin = here[new]
                end = here[np.append(new[1:], len(here)) - 1] + 4
                begin = np.maximum(begin, np.concatenate([[0], np.maximum.accumulate(end)[:-1]]))
                keep = end - begin >= 3
                length[begin[keep]], distance[begin[keep]] = (end - begin)[keep], back[here[new]][keep]
        return same, slot, length, distance

    def write(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each range of ``data`` (a positive multiple of 64 bytes, at most 16 KiB) as one file: bytes and offsets."""
        channels, pixels = data.reshape(-1, 4), data.view("<u4")
        first, count = offsets[:-1] // 4, np.diff(offsets) // 4
        image = np.repeat(np.arange(len(count)), count)
        same, slot, length, distance = self.repeats(pixels, image, first)
        plain, plain_size = self._literals(channels, self.plain)
        rich, rich_size = self._literals(channels, self.rich)
        rich, rich_size = np.where(same, self.rich.code[0][280 + slot.astype(np.int64)], rich), np.where(same, self.rich.size[0][280 + slot.astype(np.int64)], rich_size)
        at = np.flatnonzero(length)
        bits, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for base, alphabet, value in ((256, 0, length[at]), (0, 4, DISTANCE_CODE[distance[at]])):
            prefix, extra, wide = _prefixes(value)
            for c, n in ((self.rich.code[alphabet][base + prefix], self.rich.size[alphabet][base + prefix]), (extra.astype(np.uint64), wide.astype(np.uint64))):
                bits |= c << size
                size += n
        rich[at], rich_size[at] = bits, size
        inside = np.zeros(len(pixels) + 1, np.int64)  # pixels of a copy after its first have no code
        inside[at + 1] += 1
        inside[at + length[at]] -= 1
        rich_size[np.cumsum(inside[:-1]) > 0] = 0
        sizes = [np.add.reduceat(x, first) + np.uint64(c.head_bits) if len(first) else x[:0] for x, c in ((plain_size, self.plain), (rich_size, self.rich))]
        is_rich = sizes[1] < sizes[0]
        chosen = is_rich[image]
        code, size = np.where(chosen, rich, plain), np.where(chosen, rich_size, plain_size)
        code[size == 0] = 0
        head_bits = np.where(is_rich, self.rich.head_bits, self.plain.head_bits)
        bit = np.zeros(len(pixels) + 1, np.int64)
        np.cumsum(size, out=bit[1:].view(np.uint64))
        stream = -(-(head_bits + bit[offsets[1:] // 4] - bit[first]) // 8)
        total = 20 + stream + (stream & 1)
        misses = np.add.reduceat((~same).astype(np.int64), first) if len(first) else first
        other: dict[int, bytes] = {}
        for i in np.flatnonzero((misses <= FEW) & (count >= FEW_PIXELS)).tolist():
            square = pixels[first[i] : first[i] + count[i]].reshape(-1, WIDE)
            best = min((encode(square, kinds, 0, True, mode=11) for kinds in TRIED), key=len)
            if len(best) < total[i]:
                other[i], total[i] = best, len(best)
        base = np.zeros(len(total) + 1, np.int64)
        np.cumsum(total, out=base[1:])
        for i in other:  # their place is written below
            size[first[i] : first[i] + count[i]] = 0
            code[first[i] : first[i] + count[i]] = 0
        bit = bit[:-1] + np.repeat((base[:-1] + 20) * 8 + head_bits - bit[first], count)
        some = np.flatnonzero(size)
        bit, code = bit[some], code[some]
        words = np.zeros(base[-1] // 8 + 3, np.uint64)
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        if len(edge):
            words[word[edge]] |= np.bitwise_or.reduceat(code << shift, edge)
            words[word[edge] + 1] |= np.bitwise_or.reduceat((code >> np.uint64(1)) >> (np.uint64(63) - shift), edge)
        out = words.view(np.uint8)
        heads: dict[tuple, np.ndarray] = {}
        for i, (rows, kind) in enumerate(zip((count // WIDE).tolist(), is_rich.tolist(), strict=True)):
            at, n = int(base[i]), int(stream[i])
            if i in other:
                out[at : at + len(other[i])] = np.frombuffer(other[i], np.uint8)
                continue
            head = heads.get((rows, kind))
            if head is None:
                used = self.rich if kind else self.plain
                value = 0x2F | (WIDE - 1) << 8 | (rows - 1) << 22 | 1 << 36 | used.head << 40
                head = heads[rows, kind] = np.frombuffer(value.to_bytes(-(-used.head_bits // 8), "little"), np.uint8)
            out[at : at + 20] = np.frombuffer(b"RIFF" + struct.pack("<I", 12 + n + (n & 1)) + b"WEBPVP8L" + struct.pack("<I", n), np.uint8)
            out[at + 20 : at + 20 + len(head)] |= head
        return out[: base[-1]], base


class Reader:
    """Decodes many files; files without transforms and code groups whose code tables were seen before advance together."""

    def __init__(self):
        self.known: list[tuple[int, int, tuple[int, list[Prefix]]]] = []  # bits of the tables, their number, cache bits and codes

    def _codes(self, bits: Bits) -> tuple[int, list[Prefix]] | None:
        """The colour cache's bits and the codes of a stream with neither transform nor code groups, else None."""
        if bits.peek() & 1:
            return None
        for value, n, codes in self.known:
            here = int.from_bytes(bits.data[bits.at >> 3 : (bits.at + n + 7) >> 3], "little") >> (bits.at & 7)
            if here & ((1 << n) - 1) == value:
                bits.at += n
                return codes
        start = bits.at
        bits.read(1)
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits > 11 or bits.read(1):
            return None
        codes = cache_bits, read_codes(bits, cache_bits)
        n = bits.at - start
        value = int.from_bytes(bits.data[start >> 3 : (bits.at + 7) >> 3], "little") >> (start & 7) & ((1 << n) - 1)
        if len(self.known) < 64:
            self.known.append((value, n, codes))
        return codes

    def read(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The pixels of each file ``data[offsets[i]:offsets[i + 1]]``, flat."""
        out: list[np.ndarray | None] = [None] * (len(offsets) - 1)
        lanes: dict[int, list[tuple[int, int, int, int]]] = {}
        tables: dict[int, tuple[int, list[Prefix]]] = {}
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if raw[a : a + 4] == b"RIFF" and raw[a + 8 : a + 16] == b"WEBPVP8L":
                bits = Bits(raw[a + 20 : min(b, a + 8192)])
                if bits.read(8) == 0x2F:
                    width = bits.read(14) + 1
                    n = width * (bits.read(14) + 1)
                    bits.at += 4
                    codes = self._codes(bits)
                    # a window of 57 bits holds a literal, or a copy with its extra bits
                    if codes is not None and sum(c.width for c in codes[1][:4]) <= 56 and codes[1][0].width + codes[1][4].width <= 28 and n <= 1 << 14:
                        tables[id(codes)] = codes
                        lanes.setdefault(id(codes), []).append((n, (a + 20) * 8 + bits.at, i, width))
                        continue
            out[i] = decode(raw[a:b]).ravel()
        for key, found in lanes.items():
            self._lockstep(raw, *tables[key], found, out)
        return out

    @staticmethod
    def _lockstep(raw: bytes, cache_bits: int, codes: list[Prefix], lanes: list[tuple[int, int, int, int]], out: list) -> None:
        lanes.sort(key=lambda x: -x[0])
        words = np.frombuffer(raw + bytes(-len(raw) % 8 + 16), "<u8")
        counts, width = np.array([x[0] for x in lanes]), np.array([x[3] for x in lanes])
        at = np.array([x[1] for x in lanes], np.int64)
        if int(at.max()) > 8 * len(raw):
            raise ValueError("the stream ends early")
        live = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # lanes with a pixel at each step
        pixels = np.zeros((counts[0], len(lanes)), np.uint32)
        tables = [(c.symbols, c.sizes, np.uint64(c.mask)) for c in codes]
        one, top = np.uint64(1), np.uint64(63)
        last = len(words) - 2
        literal_only = bool((codes[0].symbols < 256).all())
        left, far = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        cache = np.zeros((len(lanes), 1 << cache_bits), np.uint32) if cache_bits else None
        everyone = np.arange(len(lanes))
        near = np.array(NEAR)

        def take(window, used, k):
            symbols, sizes, mask = tables[k]
            place = window & mask
            size = sizes[place]
            return symbols[place], window >> size, used + size

        def value(prefix, window, used):
            """prefix_value for many lanes."""
            prefix = prefix.astype(np.int64)
            extra = np.maximum((prefix - 2) >> 1, 0).astype(np.uint64)
            more = (window & ((one << extra) - one)).astype(np.int64)
            small = prefix < 4
            out = np.where(small, prefix + 1, ((2 + (prefix & 1)) << extra.astype(np.int64)) + more + 1)
            extra = np.where(small, np.uint64(0), extra)
            return out, window >> extra, used + extra

        for step in range(counts[0]):
            n = live[step]
            idle = everyone[:n] if literal_only else np.flatnonzero(left[:n] == 0)
            pos = at[idle]
            word, shift = pos >> 6, (pos & 63).astype(np.uint64)
            np.minimum(word, last, out=word)
            window = words[word] >> shift | (words[word + 1] << one) << (top - shift)
            green, window, used = take(window, np.zeros(len(idle), np.uint64), 0)
            if literal_only:
                literal = slice(None)
                own_window, own_used, pixel = window, used, green << np.uint64(8)
            else:
                literal = np.flatnonzero(green < 256)
                own_window, own_used, pixel = window[literal], used[literal], green[literal] << np.uint64(8)
            for k, to in ((1, 16), (2, 0), (3, 24)):
                s, own_window, own_used = take(own_window, own_used, k)
                pixel |= s << np.uint64(to)
            used[literal] = own_used
            pixels[step, idle[literal]] = pixel.astype(np.uint32)
            if not literal_only:
                cached = np.flatnonzero(green >= 280)
                if len(cached):
                    pixels[step, idle[cached]] = cache[idle[cached], (green[cached] - np.uint64(280)).astype(np.int64)]
                copy = np.flatnonzero((green >= 256) & (green < 280))
                if len(copy):
                    lane = idle[copy]
                    run, w, u = value(green[copy] - np.uint64(256), window[copy], used[copy])
                    s, w, u = take(w, u, 4)
                    code, w, u = value(s, w, u)
                    used[copy] = u
                    close = near[np.minimum(code, len(NEAR)) - 1]
                    distance = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, close[:, 0] + close[:, 1] * width[lane]))
                    if (distance > step).any() or (run > counts[lane] - step).any():
                        raise ValueError("a back-reference leaves the image")
                    left[lane], far[lane] = run, distance
                busy = np.flatnonzero(left[:n])
                if len(busy):
                    pixels[step, busy] = pixels[step - far[busy], busy]
                    left[busy] -= 1
                if cache_bits:
                    now = pixels[step, :n]
                    cache[everyone[:n], (now * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = now
            at[idle] += used.astype(np.int64)
        if int(at.max()) > 8 * (len(raw) + 1):
            raise ValueError("the stream ends early")
        columns = np.ascontiguousarray(pixels.T)
        for j, (n, _, i, _) in enumerate(lanes):
            out[i] = columns[j, :n]


# ---- media columns

MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Row:
    """What one text's images add up to."""

    def __init__(self, n: int):
        self.n, self.payload_bytes, self.media_bytes, self.tail = n, 0, 0, b""
        self.payload, self.media = hashlib.sha256(), hashlib.sha256()
        self.sums, self.steps = np.zeros(4, np.int64), 0

    def add(self, pixels: bytes, media: bytes) -> None:
        self.payload.update(pixels)
        self.media.update(media)
        self.payload_bytes += len(pixels)
        self.media_bytes += len(media)
        self.tail = pixels[-64:]
        flat = np.frombuffer(pixels, np.uint8)
        self.sums += flat.reshape(-1, 4).sum(axis=0, dtype=np.int64)
        self.steps += int(np.abs(np.diff(flat.astype(np.int16))).sum())

    def values(self) -> tuple:
        count = self.payload_bytes // 4
        means = ",".join(f"{x / count:.3f}" for x in self.sums.tolist())
        return self.n, self.payload_bytes, self.payload.hexdigest(), zlib.crc32(self.tail), self.media_bytes, self.media.hexdigest(), f"{WIDE}x{count // WIDE}:{means}:{self.steps / count:.3f}"


def _strips(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Batches of (row, image payload): each text padded with 0 to a positive multiple of 64, cut to images."""
    batch, held, side = [], 0, 4 * WIDE * TALL
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        for lo in range(a, max(b, a + 1), side):
            part = data[lo : min(b, lo + side)].tobytes()
            part += bytes(-len(part) % 64 if part else 64)
            batch.append((row, part))
            held += len(part)
            if held >= limit:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def media_column(docs: DataFrame, text: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as lossless WebP images, read them back and describe what was read.

    A text's bytes, padded with 0 to a positive multiple of 64, fill 16-pixel rows in the order
    blue, green, red, alpha; each 256 rows are one file and the files stand one after another. All
    columns but n_bytes, media_bytes and media_sha256 come from the decoded pixels. Null reads as
    empty. feature: size, channel means and mean step between neighbouring samples. The columns of
    ``docs`` other than ``text`` are kept, unless they bear one of the new names.
    """
    spec = MEDIA + (", media binary" if with_media else "")
    added = [x.split()[0] for x in spec.split(", ")]
    keep = [c for c in docs.columns if c != text and c not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep), spec])

    def run(batches):
        codec, reader = Codec(), Reader()
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            rows = [_Row(n) for n in np.diff(offsets).tolist()]
            stored: list[list[bytes]] = [[] for _ in rows]
            for strips in _strips(data, offsets, 4 << 20):
                payload = np.frombuffer(b"".join(p for _, p in strips), np.uint8)
                media, at = codec.write(payload, np.cumsum([0, *(len(p) for _, p in strips)]))
                raw = media.tobytes()
                for (row, _), pixels, a, b in zip(strips, reader.read(media, at), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    rows[row].add(pixels.astype("<u4").tobytes(), raw[a:b])
                    if with_media:
                        stored[row].append(raw[a:b])
            columns = list(zip(*(r.values() for r in rows), strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            if with_media:
                arrays.append(pa.array([b"".join(x) for x in stored], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *arrays], names=[*keep, *added])

    return docs.select(*keep, text).mapInArrow(run, schema)


def op9_lossless_webp(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its text as lossless WebP files, and what they give when they are read back.

    Null and empty texts are 64 zero bytes. A null doc_id and repeated rows are stored like any other;
    equal texts give equal files. No documents give no row. Columns other than doc_id and text are ignored.
    """
    return media_column(docs.select("doc_id", "text"))
