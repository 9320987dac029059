"""The lossless WebP bitstream: a decoder for all of it, and an encoder for the parts that this library writes.

Pixels are uint32 ARGB arrays (height, width). The decoder reads prefix codes (simple and normal, several groups
by a meta prefix image), back-references, the colour cache, and inverts the predictor, cross-colour, subtract-green
and palette (colour-indexing) transforms. The encoder writes the same elements where asked to. encode_grey chooses
for grey images among those that can pay there: a palette, a predictor, subtract-green and back-references; numpy
writes and reads literals in stretches. The colour cache and cross-colour never pay for grey, whose other channels
cost nothing once they are constant.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the public format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
MAX_SIDE = 1 << 14
#: Literals that are read at once, at most.
RUN = 4


class WebPError(ValueError):
    """The bytes aren't a lossless WebP image."""


# --- prefix codes ---------------------------------------------------------------------------------------------


def _reversed_bits(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for i in range(15):
        out |= np.where(i < n, ((v >> i) & 1) << np.maximum(n - 1 - i, 0), 0)
    return out


class Code:
    """A canonical prefix code. For each value of the next 15 bits: symbols[v] and sizes[v]."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if not len(used):
            used = np.array([0])
        self.only = int(used[0]) if len(used) == 1 else -1
        self.lengths = lengths
        if self.only >= 0:
            return
        used = used[np.lexsort((used, lengths[used]))]
        n = lengths[used].astype(np.int64)
        spans = np.int64(1) << (15 - n)
        if spans.sum() != 1 << 15:
            raise WebPError("a prefix code isn't complete")
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]])
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[used] = _reversed_bits(starts >> (15 - n), n)
        table = np.repeat(used, spans)
        back = _all_reversed()
        self.symbols = table[back].astype(np.uint16)
        self.sizes = lengths[table[back]].astype(np.uint8)

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value of the next 15 bits the literals (symbols below 256) that lie in them whole, RUN at most, how
        many they are, and their bits."""
        v, used, n = np.arange(1 << 15), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        found, open_ = np.zeros((1 << 15, RUN), np.uint8), np.ones(1 << 15, bool)
        for k in range(RUN):
            rest = v >> used
            open_ &= (used + self.sizes[rest] <= 15) & (self.symbols[rest] < 256)
            found[:, k] = np.where(open_, self.symbols[rest], 0)
            n += open_
            used += np.where(open_, self.sizes[rest], 0)
        return found, n.astype(np.uint8), used.astype(np.uint8)


@lru_cache(maxsize=1)
def _all_reversed() -> np.ndarray:
    return _reversed_bits(np.arange(1 << 15), np.full(1 << 15, 15))


@lru_cache(maxsize=256)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman lengths of at most `most` bits; counts are flattened until they fit."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used))
        for n in range(len(used), 2 * len(used) - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = n
            heapq.heapreplace(heap, (a + b, n))
        depth = [0] * (2 * len(used) - 1)
        for i in range(2 * len(used) - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            out[used] = depth[: len(used)]
            return out
        weights = [(w + 1) // 2 for w in weights]


# --- reading --------------------------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek15(self) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7)) & 0x7FFF

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise WebPError("the data end too early")

    def symbol(self, code: Code) -> int:
        if code.only >= 0:
            return code.only
        v = self.peek15()
        self.skip(int(code.sizes[v]))
        return int(code.symbols[v])


#: The last codes read, by alphabet size: (bits, their value, code). A description ends itself, so equal bits
#: describe an equal code.
_recent: dict[int, list[tuple[int, int, Code]]] = {}


def _read_code(r: Reader, size: int) -> Code:
    recent = _recent.setdefault(size, [])
    start = r.at
    for n, value, code in recent:
        if start + n <= r.end and r.peek(n) == value:
            r.skip(n)
            return code
    code = _parse_code(r, size)
    n, end = r.at - start, r.at
    r.at = start
    recent.insert(0, (n, r.peek(n), code))
    r.at = end
    del recent[4:]
    return code


def _parse_code(r: Reader, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if r.bits(1):
        two = r.bits(1)
        for s in [r.bits(8 if r.bits(1) else 1)] + ([r.bits(8)] if two else []):
            lengths[s] = 1
        return _code(lengths.tobytes())
    first = np.zeros(19, np.uint8)
    for i in range(4 + r.bits(4)):
        first[CODE_LENGTH_ORDER[i]] = r.bits(3)
    code = _code(first.tobytes())
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
        else:
            value, n = (last, 3 + r.bits(2)) if s == 16 else (0, 3 + r.bits(3)) if s == 17 else (0, 11 + r.bits(7))
            if at + n > size:
                raise WebPError("too many code lengths")
            lengths[at : at + n] = value
            at += n
    return _code(lengths.tobytes())


def _extra(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + r.bits(n) + 1


def _greens(r: Reader, code: Code, far: Code, n: int, width: int) -> np.ndarray:
    """n symbols of one code, read in stretches: sizes for every bit of a stretch, then the chain of starts. The other
    codes, but for the distances', have one symbol, so that a literal is one symbol of this code."""
    if code.only >= 0:
        return np.full(n, code.only, np.uint16)
    literals, number, bits = code.runs
    out, got = np.empty(n, np.uint16), 0
    while got < n:
        base = r.at >> 3
        raw = np.frombuffer(r.data, np.uint8, min(len(r.data) - base, 1 << 17, 2 * (n - got) + 64), base)
        if len(raw) < 3:
            raise WebPError("the data end too early")
        word = raw[:-2].astype(np.uint32) | raw[1:-1].astype(np.uint32) << np.uint32(8) | raw[2:].astype(np.uint32) << np.uint32(16)
        window = ((word[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).ravel()
        stop, p = len(window), r.at & 7
        size = bits[window].tobytes() + b"\0" * 16  # the chain stops at a back-reference, and where the stretch ends
        while got < n and p < stop:
            starts: list[int] = []
            add = starts.append
            for _ in range(n - got):
                if not (step := size[p]):
                    break
                add(p)
                p += step
            if starts:
                some = window[starts]
                count = number[some]
                made = literals[some][np.arange(RUN) < count[:, None]]
                if len(made) > n - got:  # the last of them are what follows the image
                    last = int(np.searchsorted(np.cumsum(count), n - got))
                    p = starts[last]
                    for _ in range(n - got - int(count[:last].sum())):
                        p += int(code.sizes[window[p]])
                    made = made[: n - got]
                out[got : got + len(made)] = made
                got += len(made)
            r.at = 8 * base + p
            if r.at > r.end:
                raise WebPError("the data end too early")
            if got < n and p < stop:
                s = r.symbol(code)
                if s < 256:  # a literal whose code is longer than what is left of a run's 15 bits can't be
                    raise WebPError("a code of more than 15 bits")
                if s >= 280:
                    raise WebPError("a cached colour without a cache")
                length, d = _extra(r, s - 256), _distance(_extra(r, r.symbol(far)), width)
                if d > got or got + length > n:
                    raise WebPError("a back-reference leaves the image")
                out[got : got + length] = out[got - d : got - d + length] if d >= length else np.resize(out[got - d : got], length)
                got += length
                p = r.at - 8 * base
    return out


def _distance(code: int, width: int) -> int:
    """Pixels back that a distance code stands for in an image of this width."""
    return code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _read_pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels, flat; top: the main image, which may have several groups of codes."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    groups, tile_bits, tile_wide, tiles = 1, 0, 0, None
    if top and r.bits(1):
        tile_bits = r.bits(3) + 2
        tile_wide = (width + (1 << tile_bits) - 1) >> tile_bits
        tile_high = (height + (1 << tile_bits) - 1) >> tile_bits
        tiles = ((_read_pixels(r, tile_wide, tile_high, False) >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
        groups = max(tiles) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    sizes = (256 + 24 + len(cache), 256, 256, 256, 40)
    codes = [[_read_code(r, n) for n in sizes] for _ in range(groups)]
    n = width * height
    green = codes[0][0]
    if groups == 1 and not cache_bits and all(c.only >= 0 for c in codes[0][1:4]) and green.only < 256:
        g = _greens(r, green, codes[0][4], n, width).astype(np.uint32)
        red, blue, alpha = (c.only for c in codes[0][1:4])
        return g << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    out, at, shift = [0] * n, 0, 32 - cache_bits
    cached = 0
    while at < n:
        group = codes[tiles[(at // width >> tile_bits) * tile_wide + (at % width >> tile_bits)] if tiles else 0]
        s = r.symbol(group[0])
        if s < 256:
            red, blue, alpha = r.symbol(group[1]), r.symbol(group[2]), r.symbol(group[3])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extra(r, s - 256)
            d = _distance(_extra(r, r.symbol(group[4])), width)
            if d > at or at + length > n:
                raise WebPError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            for p in out[cached:at]:
                cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> shift] = p
            cached = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


# --- transforms -----------------------------------------------------------------------------------------------


def _channels(p: np.ndarray) -> np.ndarray:
    """Bytes of each pixel in the order blue, green, red, alpha."""
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4)


def _average(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _toward_zero(v: int) -> int:
    return -((-v) >> 1) if v < 0 else v >> 1


def predict(mode: int, left: tuple, up: tuple, right: tuple, corner: tuple) -> tuple:
    """The predicted pixel (a tuple of channels) from its neighbours; right: above and to the right."""
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), up)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, up)
    if mode == 8:
        return _average(corner, up)
    if mode == 9:
        return _average(up, right)
    if mode == 10:
        return _average(_average(left, corner), _average(up, right))
    if mode == 11:
        far_left = sum(abs(u - c) for u, c in zip(up, corner, strict=True))  # |estimate - left|
        far_up = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if far_left < far_up else up
    if mode == 12:
        return tuple(_clamp(x + u - c) for x, u, c in zip(left, up, corner, strict=True))
    if mode == 13:
        middle = _average(left, up)
        return tuple(_clamp(m + _toward_zero(m - c)) for m, c in zip(middle, corner, strict=True))
    return (0, 0, 0, 255)


def _predicted(pixels: np.ndarray, modes: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    """Adds (invert) or subtracts the predictions. Each is made from true pixels, so inverting goes in order."""
    height, width = pixels.shape
    if height and width and modes.size and modes.min() == modes.max() and modes.flat[0] in (1, 2):
        return _running(pixels, int(modes.flat[0]), invert)
    given = [[tuple(map(int, p)) for p in row] for row in _channels(pixels)]
    true = [[(0, 0, 0, 0)] * width for _ in range(height)] if invert else given
    out = np.empty((height, width, 4), np.uint8)
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = true[0][x - 1] if x else (0, 0, 0, 255)
            elif x == 0:
                p = true[y - 1][0]
            else:
                above = true[y - 1]
                p = predict(int(modes[y >> bits, x >> bits]), true[y][x - 1], above[x], above[x + 1] if x + 1 < width else true[y][0], above[x - 1])
            v = tuple((a + b if invert else a - b) & 255 for a, b in zip(given[y][x], p, strict=True))
            out[y, x] = v
            if invert:
                true[y][x] = v
    return out.view("<u4").reshape(height, width)


def _running(pixels: np.ndarray, mode: int, invert: bool) -> np.ndarray:
    """_predicted where all tiles have mode 1 (left) or 2 (up): sums or differences along one axis. The first row is
    always predicted from the left, and the first column from above."""
    c = _channels(pixels).copy()
    if invert:
        c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
        if mode == 1:
            c[:, 0] = np.cumsum(c[:, 0], 0, dtype=np.uint8)
            return np.cumsum(c, 1, dtype=np.uint8).view("<u4").reshape(pixels.shape)
        c[0] = np.cumsum(c[0], 0, dtype=np.uint8)
        return np.cumsum(c, 0, dtype=np.uint8).view("<u4").reshape(pixels.shape)
    out = c.copy()
    out[0, 1:] = c[0, 1:] - c[0, :-1]
    out[0, 0, 3] = (int(out[0, 0, 3]) - 255) & 255
    if mode == 1:
        out[1:, 1:] = c[1:, 1:] - c[1:, :-1]
        out[1:, 0] = c[1:, 0] - c[:-1, 0]
    else:
        out[1:] = c[1:] - c[:-1]
    return out.view("<u4").reshape(pixels.shape)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    height, width = pixels.shape
    c = _channels(pixels).astype(np.int32)
    t = _channels(factors)[np.arange(height)[:, None] >> bits, np.arange(width) >> bits]
    green_red, green_blue, red_blue = (_signed(t[..., i]) for i in range(3))
    green, red = _signed(c[..., 1]), c[..., 2]
    sign = 1 if invert else -1
    new_red = (red + sign * (green_red * green >> 5)) & 255
    true_red = _signed(new_red if invert else red)
    c[..., 0] = (c[..., 0] + sign * ((green_blue * green >> 5) + (red_blue * true_red >> 5))) & 255
    c[..., 2] = new_red
    return c.astype(np.uint8).view("<u4").reshape(height, width)


def _subtract_green(pixels: np.ndarray, invert: bool) -> np.ndarray:
    c = _channels(pixels).copy()
    if invert:
        c[..., 0] += c[..., 1]
        c[..., 2] += c[..., 1]
    else:
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
    return c.view("<u4").reshape(pixels.shape)


def _bundle(colours: int) -> int:
    """log2 of how many indices one pixel holds."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpack(pixels: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    bundle = _bundle(len(colours))
    if bundle:
        n = 8 >> bundle
        index = ((index[..., None] >> (np.arange(1 << bundle, dtype=np.uint32) * np.uint32(n))) & np.uint32((1 << n) - 1)).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, np.uint32)  # an index without a colour is transparent black
    table[: len(colours)] = colours
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file as uint32 ARGB (height, width)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size or size < 5 or data[20] != 0x2F:
        raise WebPError("the image data are cut off or have no signature")
    r = Reader(data[21 : 20 + size])
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.skip(1)
    if r.bits(3):
        raise WebPError("unknown version")
    transforms: list[tuple[int, int, np.ndarray | None, int]] = []
    full = width
    while r.bits(1):
        kind = r.bits(2)
        if kind in {t[0] for t in transforms}:
            raise WebPError("a transform comes twice")
        bits, table = 0, None
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            wide, high = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            table = _read_pixels(r, wide, high, False).reshape(high, wide)
        elif kind == PALETTE:
            n = r.bits(8) + 1
            steps = _channels(_read_pixels(r, n, 1, False))
            table = np.cumsum(steps, 0, dtype=np.uint8).view("<u4").ravel()
        transforms.append((kind, bits, table, width))
        if kind == PALETTE:
            bundle = _bundle(n)
            width = (width + (1 << bundle) - 1) >> bundle
    pixels = _read_pixels(r, width, height, True).reshape(height, width)
    for kind, bits, table, wide in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _predicted(pixels, (table >> np.uint32(8)) & np.uint32(15), bits, True)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, table, bits, True)
        elif kind == SUBTRACT_GREEN:
            pixels = _subtract_green(pixels, True)
        else:
            pixels = _unpack(pixels, wide, table)
    return pixels.reshape(height, full)


# --- writing --------------------------------------------------------------------------------------------------


class Writer:
    """Bits as arrays of values and sizes (at most 24 bits each), joined at the end."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def bits(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def array(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.parts.append((values, sizes))

    def _flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self._flush()
        value = np.concatenate([v for v, _ in self.parts])
        size = np.concatenate([s for _, s in self.parts]).astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        value = value.astype(np.int64) << (start & 7)
        first, n = start >> 3, int(end[-1] + 7) >> 3
        out = np.zeros(n + 4)
        for k in range(4):  # no two values share a bit, so sums join them
            out[k : k + n + 1] += np.bincount(first, (value >> (8 * k)) & 255, n + 1)
        return out[:n].astype(np.uint8).tobytes()


def _write_code(w: Writer, lengths: np.ndarray) -> None:
    w.array(*_code_bits(lengths.tobytes()))


@lru_cache(maxsize=64)
def _code_bits(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of the bits that describe a code."""
    w = Writer()
    _describe(w, np.frombuffer(lengths, np.uint8))
    w._flush()
    return np.concatenate([v for v, _ in w.parts]), np.concatenate([n for _, n in w.parts])


def _describe(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and not (used > 255).any():
        used = used.tolist() or [0]
        w.bits(1, 1)
        w.bits(len(used) - 1, 1)
        w.bits(int(used[0] > 1), 1)
        w.bits(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.bits(used[1], 8)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, value of its extra bits, their number
    flat, at = lengths.tolist(), 0
    while at < len(flat):
        end = at
        while end < len(flat) and flat[end] == flat[at]:
            end += 1
        n = end - at
        if flat[at]:
            runs.append((flat[at], 0, 0))
            n -= 1
        while n >= 3 and (flat[at] or n < 11):
            step = min(n, 6 if flat[at] else 10)
            runs.append((16 if flat[at] else 17, step - 3, 2 if flat[at] else 3))
            n -= step
        while n >= 11:
            step = min(n, 138)
            runs.append((18, step - 11, 7))
            n -= step
        if n >= 3:
            runs.append((17, n - 3, 3))
            n = 0
        runs += [(flat[at], 0, 0)] * n
        at = end
    counts = np.bincount([s for s, _, _ in runs], minlength=19)
    first = code_lengths(counts, 7)
    n = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if first[s]) + 1
    n = max(n, 4)
    w.bits(0, 1)
    w.bits(n - 4, 4)
    for s in CODE_LENGTH_ORDER[:n]:
        w.bits(int(first[s]), 3)
    w.bits(0, 1)
    code = _code(first.tobytes())
    for s, extra, size in runs:
        if code.only < 0:
            w.bits(int(code.codes[s]), int(first[s]))
        w.bits(extra, size)


def _prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and its size for a length or distance code v >= 1."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + ((v >> n) & 1), v & ((1 << n) - 1), n


def _tokens(flat: list[int], width: int, cache_bits: int, matches: bool) -> list[tuple[int, ...]]:
    """(0, pixel), (1, length, distance code) or (2, cache index) in order: greedy back-references of 4 pixels and
    more to the last place with the same 4 pixels."""
    near = _near(width)
    cache, seen, out, at, shift = [0] * (1 << cache_bits), {}, [], 0, 32 - cache_bits
    while at < len(flat):
        length, d = 0, 0
        if matches:
            was = seen.get(tuple(flat[at : at + 4]), -1) if at + 4 <= len(flat) else -1
            if was >= 0:
                d = at - was
                while at + length < len(flat) and length < 4096 and flat[at + length] == flat[at + length - d]:
                    length += 1
        if length >= 4:
            out.append((1, length, near.get(d, d + 120)))
        else:
            length, p = 1, flat[at]
            if cache_bits and cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> shift] == p:
                out.append((2, ((CACHE_FACTOR * p) & 0xFFFFFFFF) >> shift))
            else:
                out.append((0, p))
        for i in range(at, at + length):
            if cache_bits:
                cache[((CACHE_FACTOR * flat[i]) & 0xFFFFFFFF) >> shift] = flat[i]
            if matches and i + 4 <= len(flat):
                seen[tuple(flat[i : i + 4])] = i
        at += length
    return out


def _write_pixels(w: Writer, pixels: np.ndarray, top: bool, cache_bits: int = 0, matches: bool = False, preset: np.ndarray | None = None) -> None:
    flat = pixels.ravel()
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if top:
        w.bits(0, 1)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    if not cache_bits and not matches:
        c = _channels(flat)
        lengths = [np.zeros(size, np.uint8), *(np.zeros(256, np.uint8) for _ in range(3))]
        for i, (channel, out) in enumerate(zip((1, 2, 0, 3), lengths, strict=True)):
            out[:256] = preset if preset is not None and not i else code_lengths(np.bincount(c[:, channel], minlength=256))
        for out in (*lengths, np.zeros(40, np.uint8)):
            _write_code(w, out)
        codes = [(_code(n.tobytes()), c[:, k]) for n, k in zip(lengths, (1, 2, 0, 3), strict=True)]
        live = [(code, v) for code, v in codes if code.only < 0]
        if live:
            w.array(np.column_stack([code.codes[v] for code, v in live]).ravel(), np.column_stack([code.lengths[v] for code, v in live]).ravel())
        return
    symbols: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra, size)
    for t in _tokens(flat.tolist(), pixels.shape[1], cache_bits, matches):
        if t[0] == 0:
            p = t[1]
            symbols.append([(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)])
        elif t[0] == 1:
            (s, extra, n), (d, far, m) = _prefix(t[1]), _prefix(t[2])
            symbols.append([(0, 256 + s, extra, n), (4, d, far, m)])
        else:
            symbols.append([(0, 280 + t[1], 0, 0)])
    counts = [np.zeros(n, np.int64) for n in (size, 256, 256, 256, 40)]
    for token in symbols:
        for k, s, _, _ in token:
            counts[k][s] += 1
    lengths = [code_lengths(n) for n in counts]
    for out in lengths:
        _write_code(w, out)
    codes = [_code(n.tobytes()) for n in lengths]
    for token in symbols:
        for k, s, extra, n in token:
            if codes[k].only < 0:
                w.bits(int(codes[k].codes[s]), int(lengths[k][s]))
            w.bits(extra, n)


#: Samples of a back-reference of encode_grey, at least, and its longest distance; tiles of a uniform predictor.
LEAST_COPY, FARTHEST, TILE = 16, (1 << 20) - 120, 9
#: Bits that a back-reference costs, about, and what a predictor's tiles do; how many times as many bits as a code of an
#: image's own a preset one may take, which saves most of the time.
COPY_BITS, PREDICTOR_BITS, PRESET_COST = 36, 400, 1.35


def copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats of LEAST_COPY samples and more, in order and apart: greedily the earliest
    start, from the first place that has the same LEAST_COPY samples."""
    n = len(flat) - LEAST_COPY + 1
    if n < 2:
        return []
    wide = np.zeros(len(flat) - 7, np.uint64)
    for i in range(8):
        wide |= flat[i : len(flat) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    key = wide[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (wide[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    # Places stand below the hashes, so that sorting numbers sorts both; places that only hashes match copy nothing.
    key = key >> np.uint64(24) << np.uint64(24) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64(0xFFFFFF)).astype(np.int64)
    key >>= np.uint64(24)
    new = np.append(True, key[1:] != key[:-1])
    if new.all():
        return []
    source = np.empty(n, np.int64)
    source[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    found = np.flatnonzero((source < np.arange(n)) & (np.arange(n) - source <= FARTHEST))
    out, k = [], 0
    while k < len(found):
        p = int(found[k])
        d, length, step = p - int(source[p]), 0, 64
        while p + length < len(flat):
            a = flat[p + length : p + length + step]
            same = a == flat[p + length - d : p + length - d + len(a)]
            if not same.all():
                length += int(same.argmin())
                break
            length, step = length + len(a), step * 2
        if length >= LEAST_COPY:
            out += [(p + at, min(4096, length - at), d) for at in range(0, length, 4096)]
            k = int(np.searchsorted(found, p + length))
        else:
            k += 1
    return out


def _bits(counts: np.ndarray) -> float:
    """Bits of as many symbols by their entropy."""
    some = counts[counts > 0]
    return float((some * np.log2(some.sum() / some)).sum())


def encode_grey(samples: np.ndarray, preset: Callable[[bool], tuple[np.ndarray, np.ndarray]] | None = None) -> bytes:
    """A lossless WebP file of 8-bit grey samples (height, width), with the elements that make it smallest, by an
    estimate: a palette for up to 16 samples, else the predictor `left` or `up`, else subtract-green alone; with
    back-references to repeats. preset: for images with repeats or without, lengths of the green code and of the
    distances', used where there is neither palette nor predictor instead of codes of their own."""
    height, width = samples.shape
    w = _header(height, width)
    colours = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(colours) <= 16:
        green = _palette(w, (colours * 0x010101 | BLACK).astype(np.uint32), np.searchsorted(colours, samples))
        w.bits(0, 1)
        _write_greens(w, green, copies(green.ravel()), 255)
        return _file(w)
    repeats = copies(samples.ravel())
    literals = np.bincount(_left(samples.ravel(), repeats), minlength=256)
    own = _bits(literals)
    plain = own + COPY_BITS * len(repeats)
    if preset is not None and float(literals @ preset(bool(repeats))[0][:256]) > PRESET_COST * own + 2000:
        preset = None
    changes = {mode: _bits(np.bincount(np.diff(samples, axis=axis, prepend=np.uint8(0)).ravel(), minlength=256)) for mode, axis in ((1, 1), (2, 0))}
    mode, alpha = min(changes, key=changes.__getitem__), 255
    if changes[mode] + PREDICTOR_BITS < plain:
        modes = np.full(((height - 1 >> TILE) + 1, (width - 1 >> TILE) + 1), mode, np.uint32)
        _write_tiled(w, PREDICTOR, TILE, (modes << np.uint32(8)) | np.uint32(BLACK))
        pixels = _predicted(samples.astype(np.uint32) * np.uint32(0x010101) | np.uint32(BLACK), modes, TILE, False)
        samples = np.ascontiguousarray(_channels(pixels)[..., 1])
        repeats, alpha, preset = copies(samples.ravel()), 0, None  # alpha is predicted wherever it is
    w.bits(1, 1)
    w.bits(SUBTRACT_GREEN, 2)
    w.bits(0, 1)
    _write_greens(w, samples, repeats, alpha, preset)
    return _file(w)


def _left(flat: np.ndarray, repeats: list[tuple[int, int, int]]) -> np.ndarray:
    """What back-references leave."""
    if not repeats:
        return flat
    edge = np.zeros(len(flat) + 1, np.int8)
    at, length = np.array(repeats)[:, :2].T
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return flat[np.cumsum(edge[:-1]) == 0]


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """Distance codes of the pixels nearby, by distance."""
    return {d: i + 1 for i, d in reversed(list(enumerate(max(1, x + y * width) for x, y in NEAR)))}


def _write_greens(w: Writer, green: np.ndarray, repeats: list[tuple[int, int, int]], alpha: int, preset: Callable[[bool], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
    """The main image, with constant channels but green: literals in stretches, and back-references."""
    flat, near = green.ravel(), _near(green.shape[1])
    coded = [(_prefix(length), _prefix(near.get(d, d + 120))) for _, length, d in repeats]
    far = np.zeros(40, np.uint8)
    if preset is None:
        lengths = code_lengths(np.bincount(_left(flat, repeats), minlength=280) + np.bincount(np.array([256 + a[0] for a, _ in coded], np.int64), minlength=280))
        far = code_lengths(np.bincount(np.array([b[0] for _, b in coded], np.int64), minlength=40))
    else:
        lengths, distances = preset(bool(repeats))
        far = distances if repeats else far
    w.bits(0, 1)
    w.bits(0, 1)
    alphas = np.zeros(256, np.uint8)
    alphas[alpha] = 1
    for one in (lengths, np.zeros(256, np.uint8), np.zeros(256, np.uint8), alphas, far):
        _write_code(w, one)
    code, distances = _code(lengths.tobytes()), _code(far.tobytes())
    at = 0
    for (start, length, _), (a, b) in zip([*repeats, (len(flat), 0, 0)], [*coded, ((0, 0, 0), (0, 0, 0))], strict=True):
        if code.only < 0 and start > at:
            w.array(code.codes[flat[at:start]], lengths[flat[at:start]])
        if length:
            if code.only < 0:
                w.bits(int(code.codes[256 + a[0]]), int(lengths[256 + a[0]]))
            w.bits(a[1], a[2])
            if distances.only < 0:
                w.bits(int(distances.codes[b[0]]), int(far[b[0]]))
            w.bits(b[1], b[2])
        at = start + length


def encode(pixels: np.ndarray, palette: bool = False, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, bits: int = 3, cache_bits: int = 0, matches: bool = False, preset: np.ndarray | None = None) -> bytes:
    """A lossless WebP file of uint32 ARGB pixels.

    palette: colour indexing (at most 256 colours). predictor: mode of each tile of 2**bits pixels a side; cross:
    ARGB factors of each tile. matches: back-references; cache_bits: size of the colour cache. preset: lengths of
    the green code, which must hold every green value, instead of those of the image's own counts.
    """
    height, width = pixels.shape
    w = _header(height, width, bool((pixels >> np.uint32(24) != 255).any()))
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        pixels = (_palette(w, colours, index.reshape(height, width)).astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK)
    if predictor is not None:
        _write_tiled(w, PREDICTOR, bits, (predictor.astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK))
        pixels = _predicted(pixels, predictor, bits, False)
    if cross is not None:
        _write_tiled(w, CROSS_COLOUR, bits, cross.astype(np.uint32))
        pixels = _cross_colour(pixels, cross.astype(np.uint32), bits, False)
    if subtract_green:
        w.bits(1, 1)
        w.bits(SUBTRACT_GREEN, 2)
        pixels = _subtract_green(pixels, False)
    w.bits(0, 1)
    _write_pixels(w, pixels, True, cache_bits, matches, preset)
    return _file(w)


def _header(height: int, width: int, alpha: bool = False) -> Writer:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side must have 1 to 16384 pixels")
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        w.bits(value, n)
    return w


def _palette(w: Writer, colours: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Writes the transform; the green channel that stands for the indices, several in a pixel where they fit."""
    if len(colours) > 256:
        raise ValueError("over 256 colours")
    w.bits(1, 1)
    w.bits(PALETTE, 2)
    w.bits(len(colours) - 1, 8)
    steps = np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    _write_pixels(w, np.ascontiguousarray(steps).view("<u4").reshape(1, -1), False)
    bundle = _bundle(len(colours))
    n = 1 << bundle
    index = np.pad(index, ((0, 0), (0, -index.shape[1] % n))).reshape(len(index), -1, n)
    return (index << (np.arange(n) * (8 >> bundle))).sum(2).astype(np.uint8)


def _file(w: Writer) -> bytes:
    data = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _write_tiled(w: Writer, kind: int, bits: int, table: np.ndarray) -> None:
    w.bits(1, 1)
    w.bits(kind, 2)
    w.bits(bits - 2, 3)
    _write_pixels(w, table, False)
