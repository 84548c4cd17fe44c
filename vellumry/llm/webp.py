"""Lossless WebP (VP8L) by its public specification: a decoder, and an encoder for tables of test images.

Pixels are 32-bit ARGB integers in row order.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter

import numpy as np

#: (x, y) offsets that the 120 short distance codes stand for, nearest first.
_PLANE = [(0, 1), (1, 0)]
for _line in (
    "1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3",
    "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6",
    "6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7",
    "7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6",
    "-7,6 8,5 7,7 -7,7 8,6 8,7",
):
    _PLANE += [tuple(map(int, p.split(","))) for p in _line.split()]
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Pixels that an image may have: as many as a row of longs can hold, 16 fewer than the format's most.
MAX_PIXELS = (1 << 28) - 16
#: Images with fewer pixels are transformed pixel by pixel, which is faster for them than arrays are.
ARRAY_PIXELS = 2048


class Damaged(ValueError):
    """The bytes are not a whole lossless WebP image."""


class Bits:
    """Little-endian bits; reading past the end by more than a code's look-ahead is damage."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.count = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk and self.at > len(self.data) + 16:
                raise Damaged("bits end early")
            self.value |= int.from_bytes(chunk, "little") << self.count
            self.count += 64
            self.at += 8

    def read(self, n: int) -> int:
        self.need(n)
        v = self.value & ((1 << n) - 1)
        self.value >>= n
        self.count -= n
        return v

    def symbol(self, code: tuple[int, list[int]]) -> int:
        width, table = code
        if not width:
            return table[0]
        if self.count < 15:
            self.need(15)
        entry = table[self.value & ((1 << width) - 1)]
        n = entry & 15
        self.value >>= n
        self.count -= n
        return entry >> 4


def _flipped(v: int, n: int) -> int:
    return int(f"{v:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length)."""
    code, out = 0, {}
    for n in range(1, 16):
        code <<= 1
        for s, k in enumerate(lengths):
            if k == n:
                out[s] = (_flipped(code, n), n)
                code += 1
    return out


def lookup(lengths: list[int]) -> tuple[int, list[int]]:
    """A table indexed by the next bits, of symbol * 16 + length."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return 0, used
    if not used or sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
        raise Damaged("prefix code is not complete")
    width = max(lengths)
    table = [0] * (1 << width)
    for s, (code, n) in canonical(lengths).items():
        for at in range(code, 1 << width, 1 << n):
            table[at] = s << 4 | n
    return width, table


def _prefix_code(bits: Bits, size: int) -> tuple[int, list[int]]:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= size:
            raise Damaged("symbol outside the alphabet")
        lengths = [0] * size
        for s in symbols:
            lengths[s] = 1
        return lookup(lengths)
    short = [0] * 19
    for i in range(4 + bits.read(4)):
        short[_LENGTH_ORDER[i]] = bits.read(3)
    coded = lookup(short)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: list[int] = []
    last = 8
    while len(lengths) < size and left:
        left -= 1
        s = bits.symbol(coded)
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            lengths += [value] * n
    if len(lengths) > size:
        raise Damaged("code lengths exceed the alphabet")
    return lookup(lengths + [0] * (size - len(lengths)))


def _extended(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _blocks(n: int, size_bits: int) -> int:
    return (n + (1 << size_bits) - 1) >> size_bits


def _image(bits: Bits, width: int, height: int, top: bool) -> array:
    """An entropy-coded image; only the outermost one may have several code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Damaged("colour cache too large")
    group_bits, groups, count = 0, None, 1
    if top and bits.read(1):
        group_bits = bits.read(3) + 2
        groups = [p >> 8 & 0xFFFF for p in _image(bits, _blocks(width, group_bits), _blocks(height, group_bits), False)]
        count = max(groups) + 1
    cache = [0] * (1 << cache_bits)
    sizes = (280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_prefix_code(bits, n) for n in sizes] for _ in range(count)]
    green, red, blue, alpha, distance = codes[0]
    wide = _blocks(width, group_bits) if groups else 0
    if count == 1 and not (green[0] or red[0] or blue[0] or alpha[0]) and green[1][0] < 256:  # one colour, in no bits
        return array("I", [alpha[1][0] << 24 | red[1][0] << 16 | green[1][0] << 8 | blue[1][0]]) * (width * height)
    out = array("I")
    total, cached, shift = width * height, 0, 32 - cache_bits
    symbol = bits.symbol
    while len(out) < total:
        if groups:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, distance = codes[groups[(y >> group_bits) * wide + (x >> group_bits)]]
        g = symbol(green)
        if g < 256:
            r = symbol(red)
            b = symbol(blue)
            out.append(symbol(alpha) << 24 | r << 16 | g << 8 | b)
        elif g < 280:
            length = _extended(bits, g - 256)
            d = _extended(bits, symbol(distance))
            if d > 120:
                d -= 120
            else:
                dx, dy = _PLANE[d - 1]
                d = max(1, dx + dy * width)
            if d > len(out) or len(out) + length > total:
                raise Damaged("back-reference outside the image")
            if d >= length:
                out += out[len(out) - d : len(out) - d + length]
            else:
                for _ in range(length):
                    out.append(out[-d])
        else:
            while cached < len(out):
                p = out[cached]
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
                cached += 1
            out.append(cache[g - 280])
    return out


def _add(a: int, b: int) -> int:
    """Sum of the four channels, each modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _mean(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(values) -> int:
    a, r, g, b = (0 if v < 0 else 255 if v > 255 else v for v in values)
    return a << 24 | r << 16 | g << 8 | b


def _predicted(mode: int, left: int, above: int, right: int, corner: int) -> int:
    """``right`` is the pixel above and to the right."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, above, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), above)
    if mode < 10:
        return _mean(*((left, corner), (left, above), (corner, above), (above, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(above, right))
    c = _channels(corner)
    if mode == 11:
        a, b = _channels(left), _channels(above)
        return left if sum(abs(y - z) for y, z in zip(b, c)) < sum(abs(x - z) for x, z in zip(a, c)) else above
    if mode == 12:
        return _joined(x + y - z for x, y, z in zip(_channels(left), _channels(above), c))
    return _joined(x + int((x - z) / 2) for x, z in zip(_channels(_mean(left, above)), c))


def _predict_at(image: list[int], at: int, x: int, y: int, width: int, modes: list[int], bits: int, wide: int) -> int:
    if not y:
        return image[at - 1] if x else 0xFF000000
    if not x:
        return image[at - width]
    mode = modes[(y >> bits) * wide + (x >> bits)] >> 8 & 15
    return _predicted(mode, image[at - 1], image[at - width], image[at - width + 1], image[at - width - 1])


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _crossed(p: int, element: int, sign: int) -> int:
    """Adds (sign 1) or takes away (-1) what green tells about red and blue, and red about blue."""
    a, r, g, b = _channels(p)
    to_red, to_blue, red_to_blue = _signed(element & 255), _signed(element >> 8 & 255), _signed(element >> 16 & 255)
    new = r + sign * (to_red * _signed(g) >> 5) & 255
    b += sign * (to_blue * _signed(g) >> 5)
    b += sign * (red_to_blue * _signed(new if sign > 0 else r) >> 5)
    return a << 24 | new << 16 | g << 8 | b & 255


def _chunk(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file, extended or not."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise Damaged("chunk ends early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise Damaged("no lossless image")


def decode(data: bytes) -> tuple[int, int, list[int] | np.ndarray]:
    """(width, height, pixels); the pixels of larger images are an array."""
    try:
        return _decode(data)
    except (IndexError, OverflowError) as e:
        raise Damaged(str(e)) from e


def _decode(data: bytes) -> tuple[int, int, list[int] | np.ndarray]:
    bits = Bits(_chunk(data))
    if bits.read(8) != 0x2F:
        raise Damaged("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise Damaged("unknown version")
    if width * height > MAX_PIXELS:
        raise Damaged("more pixels than a row can hold")
    transforms, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Damaged("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            wide = _blocks(inner, size_bits)
            transforms.append((kind, inner, size_bits, _image(bits, wide, _blocks(height, size_bits), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _image(bits, n, 1, False)
            for i in range(1, n):
                table[i] = _add(table[i], table[i - 1])
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, inner, pack, table))
            inner = _blocks(inner, pack)
        else:
            transforms.append((kind, inner, 0, array("I")))
    image = _image(bits, inner, height, True)
    if bits.at - (bits.count >> 3) > len(bits.data) + 8:
        raise Damaged("bits end early")
    if width * height >= ARRAY_PIXELS:
        return width, height, _inverted(np.frombuffer(image, np.uint32), transforms, height, has_alpha)
    image = image.tolist()
    for kind, w, n, extra in reversed(transforms):
        if kind == PREDICTOR:
            wide = _blocks(w, n)
            for at in range(w * height):
                y, x = divmod(at, w)
                image[at] = _add(image[at], _predict_at(image, at, x, y, w, extra, n, wide))
        elif kind == CROSS_COLOUR:
            wide = _blocks(w, n)
            image = [_crossed(p, extra[(at // w >> n) * wide + (at % w >> n)], 1) for at, p in enumerate(image)]
        elif kind == SUBTRACT_GREEN:
            image = [_add(p, (p >> 8 & 255) * 0x10001) for p in image]
        else:
            table = extra.tolist() + [0] * (256 - len(extra))
            if not n:
                image = [table[p >> 8 & 255] for p in image]
                continue
            packed, per, mask = _blocks(w, n), 8 >> n, (1 << (8 >> n)) - 1
            image = [table[(image[y * packed + (x >> n)] >> 8 >> (x & (1 << n) - 1) * per) & mask] for y in range(height) for x in range(w)]
    if not has_alpha:
        image = [p | 0xFF000000 for p in image]
    return width, height, image


def _tiled(extra: array, w: int, height: int, n: int) -> np.ndarray:
    """A value a block as a value a pixel."""
    wide = _blocks(w, n)
    tiles = np.frombuffer(extra, np.uint32).reshape(-1, wide)
    return np.repeat(np.repeat(tiles, 1 << n, 0)[:height], 1 << n, 1)[:, :w]


def _inverted(image: np.ndarray, transforms: list[tuple], height: int, has_alpha: int) -> np.ndarray:
    """The transforms undone on whole arrays."""
    u = np.uint32
    for kind, w, n, extra in reversed(transforms):
        if kind == PREDICTOR:
            image = _unpredicted(image.reshape(height, w), _tiled(extra, w, height, n) >> u(8) & u(15)).ravel()
        elif kind == CROSS_COLOUR:
            tiles = _tiled(extra, w, height, n).ravel()

            def signed(v: np.ndarray) -> np.ndarray:
                return (v & u(255)).astype(np.uint8).view(np.int8).astype(np.int32)

            green = signed(image >> u(8))
            red = (image >> u(16) & u(255)).astype(np.int32) + (signed(tiles) * green >> 5) & 255
            blue = (image & u(255)).astype(np.int32) + (signed(tiles >> u(8)) * green >> 5) + (signed(tiles >> u(16)) * signed(red.astype(u)) >> 5) & 255
            image = image & u(0xFF00FF00) | red.astype(u) << u(16) | blue.astype(u)
        elif kind == SUBTRACT_GREEN:
            green = image >> u(8) & u(255)
            image = image & u(0xFF00FF00) | (image & u(0xFF00FF)) + (green << u(16) | green) & u(0xFF00FF)
        else:
            table = np.zeros(256, u)
            table[: len(extra)] = extra
            index = image >> u(8) & u(255)
            if n:
                per = 8 >> n
                index = index.reshape(height, -1, 1) >> np.arange(0, 8, per, dtype=u) & u((1 << per) - 1)
                index = index.reshape(height, -1)[:, :w].ravel()
            image = table[index]
    return image if has_alpha else image | u(0xFF000000)


def _unpredicted(image: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """The predictor transform undone along slanted lines: a pixel needs only those of x + 2 y one to three less, so all
    pixels of one such sum are predicted together, mode by mode."""
    height, w = image.shape
    out = np.zeros((height + 1, w + 2), np.uint32)  # a row above; a column on either side
    a = np.arange(height)
    left_add = np.uint32(0xFF00FF00), np.uint32(0x00FF00FF)

    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x & left_add[0]) + (y & left_add[0]) & left_add[0] | (x & left_add[1]) + (y & left_add[1]) & left_add[1]

    def mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x & y) + (((x ^ y) & np.uint32(0xFEFEFEFE)) >> np.uint32(1))

    def split(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).astype(np.int32)

    def joined(x: np.ndarray) -> np.ndarray:
        return np.clip(x, 0, 255).astype(np.uint8).view(np.uint32).ravel()

    def predicted(mode: int, left: np.ndarray, above: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
        if mode == 0 or mode > 13:
            return np.full(len(left), 0xFF000000, np.uint32)
        if mode < 5:
            return (left, above, right, corner)[mode - 1]
        if mode == 5:
            return mean(mean(left, right), above)
        if mode < 10:
            return mean(*((left, corner), (left, above), (corner, above), (above, right))[mode - 6])
        if mode == 10:
            return mean(mean(left, corner), mean(above, right))
        c = split(corner)
        if mode == 11:
            p, q = split(left), split(above)
            return np.where(np.abs(q - c).sum(1) < np.abs(p - c).sum(1), left, above)
        if mode == 12:
            return joined(split(left) + split(above) - c)
        m = split(mean(left, above))
        return joined(m + np.trunc((m - c) / 2).astype(np.int32))

    for t in range(w + 2 * height - 2):
        y = a[max(0, (t - w + 2) // 2) : min(height, t // 2 + 1)]
        x = t - 2 * y
        left, above, right, corner = out[y + 1, x], out[y, x + 1], out[y, x + 2], out[y, x]
        # the pixel to the right of a row's last one is the first of the row below, which is there already
        edge = x == w - 1
        if edge.any():
            right = np.where(edge, out[y + 1, np.ones_like(y)], right)
        mode = np.where(y == 0, 1, np.where(x == 0, 2, modes[y, x]))
        value = np.empty(len(y), np.uint32)
        for k in np.unique(mode).tolist():
            some = mode == k
            value[some] = predicted(k, left[some], above[some], right[some], corner[some])
        if t == 0:
            value[:] = 0xFF000000
        out[y + 1, x + 1] = add(image[y, x], value)
    return out[1:, 1:-1]


class _Writer:
    def __init__(self):
        self.value, self.count = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.count
        self.count += n


def _lengths(counts: Counter, size: int, most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits (counts are flattened until they fit)."""
    out = [0] * size
    used = dict(counts)
    if len(used) < 2:
        for s in used or {0: 1}:
            out[s] = 1
        return out
    while True:
        heap = [(n, s, (s,)) for s, n in used.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            (n, a, x), (m, b, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (n + m, min(a, b), x + y))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        used = {s: (n + 1) // 2 + 1 for s, n in used.items()}


def _write_code(w: _Writer, counts: Counter, size: int) -> dict[int, tuple[int, int]]:
    """Writes a prefix code; returns what to put for each symbol."""
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and max(symbols) < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        return {symbols[0]: (0, 0)} if len(symbols) == 1 else {symbols[0]: (0, 1), symbols[1]: (1, 1)}
    lengths = _lengths(counts, size, 15)
    if len(symbols) == 1:
        lengths[0 if symbols[0] else 1] = 1  # a lone large symbol has no short form: a second one completes the code
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at, last = 0, 8
    end = max(s for s, n in enumerate(lengths) if n) + 1
    while at < end:
        n = lengths[at]
        run = 1
        while at + run < end and lengths[at + run] == n:
            run += 1
        if n == 0 and run >= 3:
            run = min(run, 138)
            runs.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
        elif n == last and run >= 3:
            run = min(run, 6)
            runs.append((16, run - 3, 2))
        else:
            run = 1
            runs.append((n, 0, 0))
            last = n or last
        at += run
    short = Counter(s for s, _, _ in runs)
    if len(short) == 1:
        short[next(s for s in (0, 1) if s not in short)] += 1
    short_lengths = _lengths(short, 19, 7)
    w.put(0, 1)
    used = max(i for i, s in enumerate(_LENGTH_ORDER) if short_lengths[s]) + 1
    used = max(used, 4)
    w.put(used - 4, 4)
    for i in range(used):
        w.put(short_lengths[_LENGTH_ORDER[i]], 3)
    w.put(1, 1)
    n = max(2, (len(runs) - 2).bit_length() + ((len(runs) - 2).bit_length() & 1))
    w.put((n - 2) // 2, 3)
    w.put(len(runs) - 2 if len(runs) >= 2 else 0, n)
    short_codes = canonical(short_lengths)
    for s, v, extra in runs:
        w.put(*short_codes[s])
        w.put(v, extra)
    return canonical(lengths)


def _extension(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _write_image(w: _Writer, image: list[int], width: int, top: bool, cache_bits: int = 0, matches: bool = False) -> None:
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    steps: list[tuple] = []
    cache, shift, seen, at = {}, 32 - cache_bits, {}, 0
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(_PLANE)))}
    while at < len(image):
        length = 0
        if matches and at + 3 <= len(image):
            back = seen.get(tuple(image[at : at + 3]))
            if back is not None:
                while at + length < len(image) and length < 4096 and image[back + length] == image[at + length]:
                    length += 1
        if length >= 3:
            d = at - back
            steps.append(("copy", _extension(length), _extension(near.get(d, d + 120))))
        else:
            length = 1
            p = image[at]
            key = (0x1E35A7BD * p & 0xFFFFFFFF) >> shift if cache_bits else 0
            steps.append(("cache", key) if cache_bits and cache.get(key) == p else ("pixel", p))
        for i in range(at, at + length):
            if cache_bits:
                cache[(0x1E35A7BD * image[i] & 0xFFFFFFFF) >> shift] = image[i]
            if matches and i + 3 <= len(image):
                seen[tuple(image[i : i + 3])] = i
        at += length
    counts = [Counter() for _ in range(5)]
    for s in steps:
        if s[0] == "pixel":
            a, r, g, b = _channels(s[1])
            for c, v in zip(counts, (g, r, b, a)):
                c[v] += 1
        elif s[0] == "copy":
            counts[0][256 + s[1][0]] += 1
            counts[4][s[2][0]] += 1
        else:
            counts[0][280 + s[1]] += 1
    codes = [_write_code(w, c, n) for c, n in zip(counts, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))]
    for s in steps:
        if s[0] == "pixel":
            a, r, g, b = _channels(s[1])
            for c, v in zip(codes, (g, r, b, a)):
                w.put(*c[v])
        elif s[0] == "copy":
            for code, base, (symbol, v, extra) in ((codes[0], 256, s[1]), (codes[4], 0, s[2])):
                w.put(*code[base + symbol])
                w.put(v, extra)
        else:
            w.put(*codes[0][280 + s[1]])


def encode(width: int, height: int, pixels: list[int], transforms: tuple[int, ...] = (), cache_bits: int = 0, matches: bool = False, mode: int = 11, cross: int = 0x00102030) -> bytes:
    """A lossless WebP file; ``transforms`` are applied in the order given. For test tables, not for small files."""
    w, image, inner = _Writer(), list(pixels), width
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(any(p >> 24 != 255 for p in pixels)), 1)
    w.put(0, 3)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = 2
            wide = _blocks(inner, n)
            blocks = wide * _blocks(height, n)
            extra = [0xFF000000 | (mode + i) % 14 << 8 for i in range(blocks)] if kind == PREDICTOR else [0xFF000000 | cross] * blocks
            w.put(n - 2, 3)
            _write_image(w, extra, wide, False)
            if kind == PREDICTOR:
                taken = [_predict_at(image, i, i % inner, i // inner, inner, extra, n, wide) for i in range(len(image))]
                image = [_joined((x - y) & 255 for x, y in zip(_channels(p), _channels(q))) for p, q in zip(image, taken)]
            else:
                image = [_crossed(p, cross, -1) for p in image]
        elif kind == SUBTRACT_GREEN:
            image = [p & 0xFF00FF00 | ((p >> 16) - (p >> 8) & 255) << 16 | (p - (p >> 8)) & 255 for p in image]
        else:
            table = sorted(set(image))
            if len(table) > 256:
                raise ValueError("a palette holds 256 colours")
            w.put(len(table) - 1, 8)
            steps = [_joined((x - y) & 255 for x, y in zip(_channels(p), _channels(q))) for p, q in zip(table, [0, *table])]
            _write_image(w, steps, len(table), False)
            n = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            at = {p: i for i, p in enumerate(table)}
            packed, per = _blocks(inner, n), 8 >> n
            new = [0xFF000000] * (packed * height)
            for i, p in enumerate(image):
                y, x = divmod(i, inner)
                new[y * packed + (x >> n)] |= at[p] << 8 << (x & (1 << n) - 1) * per
            image, inner = new, packed
    w.put(0, 1)
    _write_image(w, image, inner, True, cache_bits, matches)
    body = w.value.to_bytes((w.count + 7) // 8, "little")
    pad = b"\0" * (len(body) & 1)
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + pad
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
