"""Lossless WebP (VP8L, RFC 9649): a decoder of the whole format, and an encoder.

``decode`` reads any lossless file: prefix codes in groups, back-references, the colour cache, and
the predictor, cross-colour, subtract-green and palette transforms. Images in which only green has
a code with bits are decoded by tables: the length of the code that would begin at every bit is
looked up at once, and a walk over these lengths finds the codes. Others go symbol by symbol.
``encode`` writes pixel arrays with any of those tools; ``encode_payload`` writes bytes as palette
images with Huffman codes, back-references for repeats and for padding, and a predictor where its
residuals cost less.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np

#: The order in which code-length code lengths are stored (fixed by the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Repeat symbols of code lengths: fewest repeats and extra bits.
REPEATS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}
#: Bytes of the stream that are looked up at once.
STRETCH = 1 << 14
#: Bits of the stream that the reading of a code's lengths holds as one number.
AHEAD = 512
LITERALS, LENGTHS, DISTANCES, MULTIPLIER = 256, 24, 40, 0x1E35A7BD
BLACK = 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


@cache
def near_offsets() -> tuple[tuple[int, int], ...]:
    """The 120 neighbours that short distance codes name, nearest first."""
    found = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return tuple(sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


def _true_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = near_offsets()[code - 1]
    return max(1, dx + dy * width)


# --- reading ---------------------------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def word(self) -> int:
        """The next ``AHEAD`` bits, or more, as one number."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + AHEAD // 8 + 1], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return value


@cache
def _reversed(n: int) -> np.ndarray:
    """The numbers below ``1 << n`` with their bits in the opposite order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Code:
    """A canonical prefix code; ``single`` codes take no bits."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted((n, s) for s, n in lengths.items() if n)
        if not used:
            raise ValueError("a prefix code without symbols")
        self.single = used[0][1] if len(used) == 1 else None
        self.first: list[tuple[int, int, int]] = []
        self.symbols = [s for _, s in used]
        self.lengths = [n for n, _ in used]
        if self.single is None:
            code = index = 0
            for n in range(1, 16):
                count = sum(1 for m, _ in used if m == n)
                self.first.append((code, index, count))
                index += count
                code = (code + count) << 1
            if code != 1 << 16:
                raise ValueError("a prefix code that is not complete")
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length for every next ``self.lengths[-1]`` bits of the stream."""
        if self._tables is None:
            most = self.lengths[-1]
            each = 1 << (most - np.array(self.lengths))
            order = _reversed(most)
            self._tables = np.repeat(np.array(self.symbols, np.int64), each)[order], np.repeat(np.array(self.lengths, np.uint8), each)[order]
        return self._tables

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        window, value = bits.peek(15), 0
        for n, (code, index, count) in enumerate(self.first):
            value = value << 1 | (window >> n & 1)
            if value - code < count:
                bits.at += n + 1
                return self.symbols[index + value - code]
        raise ValueError("no such prefix code")


@lru_cache(256)
def _code(lengths: tuple[tuple[int, int], ...]) -> Code:
    return Code(dict(lengths))


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        return _code(tuple((s, 1) for s in symbols))
    count = 4 + bits.read(4)
    own = {LENGTH_ORDER[k]: bits.read(3) for k in range(count)}
    code = Code(own)
    most = size if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    symbols, widths = ([code.single], [0]) if code.single is not None else (t.tolist() for t in code.tables())
    mask, word, used = len(symbols) - 1, bits.word(), 0
    lengths: dict[int, int] = {}
    at, before = 0, 8
    while at < size and most:
        most -= 1
        if used > AHEAD - 16:
            bits.at += used
            word, used = bits.word(), 0
        w = word >> used & mask
        s = symbols[w]
        used += widths[w]
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            least, extra = REPEATS[s]
            n = least + (word >> used & (1 << extra) - 1)
            used += extra
            if at + n > size:
                raise ValueError("code lengths run over the alphabet")
            if s == 16:
                lengths.update(dict.fromkeys(range(at, at + n), before))
            at += n
    bits.at += used
    if bits.at > bits.end:
        raise ValueError("the stream ends too early")
    return _code(tuple(lengths.items()))


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB; ``main`` images may have groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        tiles = _read_image(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
        groups = (tiles >> 8 & 0xFFFF).astype(np.int64)
    count = 1 if groups is None else int(groups.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(count)]
    total = width * height
    green, red, blue, alpha, _ = codes[0]
    flat = [c.single for c in (red, blue, alpha)]
    if groups is None and not cache_bits and green.single is None and None not in flat:
        return _read_greens(bits, codes[0], total, width).reshape(height, width)
    out = np.empty(total, np.uint32)
    store = [0] * (1 << cache_bits) if cache_bits else None
    stored = at = 0
    while at < total:
        if groups is not None:
            green, red, blue, alpha, far = codes[groups[at // width >> shift, at % width >> shift]]
        else:
            far = codes[0][4]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < LITERALS + LENGTHS:
            n = _prefixed(bits, s - LITERALS)
            d = _true_distance(_prefixed(bits, far.read(bits)), width)
            _copy(out, at, d, n)
            at += n
        else:
            while stored < at:
                store[(MULTIPLIER * int(out[stored]) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(out[stored])
                stored += 1
            out[at] = store[s - LITERALS - LENGTHS]
            at += 1
    return out.reshape(height, width)


def _copy(out: np.ndarray, at: int, d: int, n: int) -> None:
    if d > at or at + n > len(out):
        raise ValueError("a back-reference out of the image")
    if d >= n:
        out[at : at + n] = out[at - d : at - d + n]
    else:
        out[at : at + n] = np.resize(out[at - d : at], n)


def _read_greens(bits: Bits, codes: list[Code], total: int, width: int) -> np.ndarray:
    """Pixels of which only green has a code with bits, by tables over stretches of the stream."""
    green, red, blue, alpha, far = codes
    base = np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
    symbols, lengths = green.tables()
    # A back-reference ends the walk; it is read by itself.
    steps = np.where(symbols < LITERALS, lengths, 0).astype(np.uint8)
    mask = np.uint32(len(symbols) - 1)
    out, at = np.empty(total, np.uint32), 0
    while at < total:
        first = bits.at >> 3
        raw = np.frombuffer(bits.data[first : first + STRETCH + 2].ljust(STRETCH + 2 if len(bits.data) - first > STRETCH else len(bits.data) - first + 2, b"\0"), np.uint8).astype(np.uint32)
        word = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        window = (word[:, None] >> np.arange(8, dtype=np.uint32) & mask).ravel()
        n = len(window)
        # How far one code, two codes and four codes lead from every bit.
        one = np.zeros(n + 64, np.uint8)
        one[:n] = steps[window]
        places = np.arange(n + 64)
        two = one + one[np.minimum(places + one, n)]
        jumps = (two + two[np.minimum(places + two, n)]).tobytes()
        p = bits.at - 8 * first
        if n <= p:
            raise ValueError("the stream ends too early")
        while p < n and at < total:
            walk = []
            while p < n and (s := jumps[p]):
                walk.append(p)
                p += s
            if walk:
                found = np.empty((len(walk), 4), np.int64)
                found[:, 0] = walk
                found[:, 1] = found[:, 0] + one[found[:, 0]]
                found[:, 2] = found[:, 0] + two[found[:, 0]]
                found[:, 3] = found[:, 2] + one[found[:, 2]]
                tokens = found.ravel()
                # Codes that begin behind the stretch belong to the next one.
                k = min(int(np.searchsorted(tokens, min(p, n))), total - at)
                tokens = tokens[:k]
                out[at : at + k] = base | symbols[window[tokens]].astype(np.uint32) << np.uint32(8)
                at += k
                p = int(tokens[-1]) + int(one[tokens[-1]])
            bits.at = 8 * first + p
            if bits.at > bits.end:
                raise ValueError("the stream ends too early")
            if p < n and at < total:
                length = _prefixed(bits, green.read(bits) - LITERALS)
                _copy(out, at, _true_distance(_prefixed(bits, far.read(bits)), width), length)
                at += length
                p = bits.at - 8 * first
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(…, 4) as signed integers in the order A, R, G, B."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, right, corner):
    """The prediction of ``mode`` from L, T, TR and TL; works on pixels (4,) and on rows (n, 4)."""
    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, right, corner)[mode - 2]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode in (6, 7):
        return left + (corner, top)[mode - 6] >> 1
    if mode in (8, 9):
        return top + (corner, right)[mode - 8] >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=-1, keepdims=True) < np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), top.shape)


def _predictions(image: np.ndarray, y: int, modes: np.ndarray, inverse: bool, residual: np.ndarray | None = None) -> np.ndarray:
    """Row ``y``: predictions from ``image``; when inverting, the row is completed on the way."""
    width = image.shape[1]
    out = np.empty((width, 4), np.int32)
    black = np.array([255, 0, 0, 0], np.int32)

    def put(x: int, value: np.ndarray) -> None:
        out[x] = value
        if inverse:
            image[y, x] = (residual[x] + value) & 255

    if y == 0:
        put(0, black)
        if inverse:
            image[0] = np.cumsum(residual + np.where(np.arange(width)[:, None] == 0, black, 0), axis=0) & 255
        out[1:] = image[0, :-1]
        return out
    put(0, image[y - 1, 0])
    x = 1
    while x < width:
        mode, end = int(modes[x]), x + 1
        while end < width and modes[end] == mode:
            end += 1
        above = image[y - 1]
        # Modes that look at the row above only, but for the last column's TR, go as arrays.
        if mode in (0, 2, 4, 8) or (mode in (3, 9) and end < width) or not inverse:
            beside = above[x + 1 : end + 1] if end < width else np.concatenate([above[x + 1 : end], image[y, :1]])
            out[x:end] = _predict(mode, image[y, x - 1 : end - 1], above[x:end], beside, above[x - 1 : end - 1])
            if inverse:
                image[y, x:end] = (residual[x:end] + out[x:end]) & 255
        elif mode == 1:
            image[y, x:end] = (np.cumsum(residual[x:end], axis=0) + image[y, x - 1]) & 255
            out[x:end] = image[y, x - 1 : end - 1]
        else:
            for i in range(x, end):
                put(i, _predict(mode, image[y, i - 1], above[i], above[i + 1] if i + 1 < width else image[y, 0], above[i - 1]))
        x = end
    return out


def _tile_modes(tiles: np.ndarray, shift: int, y: int, width: int) -> np.ndarray:
    return (tiles[y >> shift] >> 8 & 15)[np.arange(width) >> shift].astype(np.int64)


def _unpredict(pixels: np.ndarray, tiles: np.ndarray, shift: int) -> np.ndarray:
    residual = _channels(pixels)
    image = np.zeros_like(residual)
    for y in range(len(image)):
        _predictions(image, y, _tile_modes(tiles, shift, y, image.shape[1]), True, residual[y])
    return _pixels(image)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, tiles: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    c = _channels(pixels)
    h, w = pixels.shape
    t = _channels(tiles)[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    red_blue, green_blue, green_red = (_signed(t[..., k]) for k in (1, 2, 3))
    green = _signed(c[..., 2])
    red = c[..., 1]
    sign = 1 if inverse else -1
    new_red = (red + sign * (green_red * green >> 5)) & 255
    source = _signed(new_red if inverse else red)
    c[..., 3] = (c[..., 3] + sign * ((green_blue * green >> 5) + (red_blue * source >> 5))) & 255
    c[..., 1] = new_red
    return _pixels(c)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _pixels(c)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    shift = _bundle(len(table))
    index = pixels >> 8 & 255
    if shift:
        each = 8 >> shift
        index = (index[:, :, None] >> (np.arange(1 << shift) * each).astype(np.uint32) & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file as (height, width) uint32 ARGB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if 20 + size > len(data):
        raise ValueError("the file is cut off")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in undo]:
            raise ValueError("a transform that occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            tiles = _read_image(bits, (now + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
            undo.append((kind, tiles, shift))
        elif kind == PALETTE:
            table = _channels(_read_image(bits, bits.read(8) + 1, 1, False)[0])
            table = _pixels(np.cumsum(table, axis=0))
            undo.append((kind, table, now))
            shift = _bundle(len(table))
            now = (now + (1 << shift) - 1) >> shift
        else:
            undo.append((kind,))
    pixels = _read_image(bits, now, height, True)
    for kind, *more in reversed(undo):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, *more)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, *more, True)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            pixels = _unpalette(pixels, *more)
    return pixels


# --- writing ---------------------------------------------------------------------------------


class Sink:
    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.word = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.n
        self.n += n

    def bits(self, array: np.ndarray) -> None:
        self._spill()
        self.parts.append(array)

    def _spill(self) -> None:
        if self.n:
            raw = np.frombuffer(self.word.to_bytes(self.n + 7 >> 3, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, bitorder="little")[: self.n])
            self.word = self.n = 0

    def bytes(self) -> bytes:
        self._spill()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def code_lengths(counts: Counter, most: int = 15) -> dict[int, int]:
    """Huffman lengths of at most ``most``, by flattening the counts until they fit."""
    used = {s: c for s, c in counts.items() if c}
    if len(used) < 2:
        return dict.fromkeys(used or [0], 1)
    while True:
        order = sorted(used, key=lambda s: (used[s], s))
        weight, n = [used[s] for s in order], len(order)
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for k in range(n, 2 * n - 1):
            weight.append(0)
            for _ in range(2):
                if leaf < n and (inner == k or weight[leaf] <= weight[inner]):
                    pick, leaf = leaf, leaf + 1
                else:
                    pick, inner = inner, inner + 1
                weight[k] += weight[pick]
                parent[pick] = k
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= most:
            return dict(zip(order, depth, strict=False))
        used = {s: (c >> 1) + 1 for s, c in used.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code as it lies in the stream, length)."""
    if len(lengths) == 1:
        return dict.fromkeys(lengths, (0, 0))
    out, code, before = {}, 0, 0
    used = sorted((n, s) for s, n in lengths.items() if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    for n, s in used:
        code <<= n - before
        before = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def write_code(sink: Sink, lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Write a prefix code and return it."""
    used = sorted(s for s, n in lengths.items() if n)
    if len(used) <= 2 and used[-1] < 256 and all(lengths[s] == 1 for s in used):
        wide = used[0] > 1
        sink.put(1 | (len(used) - 1) << 1 | wide << 2, 3)
        sink.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            sink.put(used[1], 8)
        return canonical(lengths)
    # Runs: (code-length symbol, extra value, extra bits).
    steps, at, before = [], 0, 8
    while at <= used[-1]:
        n, run = lengths.get(at, 0), 1
        while at + run <= used[-1] and lengths.get(at + run, 0) == n:
            run += 1
        at += run
        if n and n != before:
            steps.append((n, 0, 0))
            before, run = n, run - 1
        while run:
            if n == 0 and run >= 11:
                k = min(run, 138)
                steps.append((18, k - 11, 7))
            elif n == 0 and run >= 3:
                k = min(run, 10)
                steps.append((17, k - 3, 3))
            elif n and run >= 3:
                k = min(run, 6)
                steps.append((16, k - 3, 2))
            else:
                k = 1
                steps.append((n, 0, 0))
            run -= k
    own = code_lengths(Counter(s for s, _, _ in steps), 7)
    table = canonical(own)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if own.get(s)) + 1
    last = max(last, 4)
    sink.put(0, 1)
    sink.put(last - 4, 4)
    for s in LENGTH_ORDER[:last]:
        sink.put(own.get(s, 0), 3)
    sink.put(1, 1)
    # How many code-length symbols follow.
    need = max(2, len(steps))
    width = max(2, (need - 2).bit_length() + ((need - 2).bit_length() & 1))
    sink.put((width - 2) // 2, 3)
    sink.put(need - 2, width)
    for s, value, n in steps:
        sink.put(*table[s])
        sink.put(value, n)
    return canonical(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or a distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


@dataclass(frozen=True)
class Tools:
    """What ``encode`` uses: a predictor mode, cross-colour factors (green-red, green-blue,
    red-blue), subtract-green, a palette, colour-cache bits, back-references, code groups."""

    predictor: int | None = None
    cross: tuple[int, int, int] | None = None
    subtract_green: bool = False
    palette: bool = False
    cache_bits: int = 0
    references: bool = False
    groups: bool = False
    shift: int = 3


def _tokens(flat: np.ndarray, cache_bits: int, references: bool) -> list[tuple]:
    """Literals, copies of earlier runs and cache hits, greedily."""
    pixels = flat.tolist()
    seen: dict[tuple, int] = {}
    store = [0] * (1 << cache_bits) if cache_bits else []
    key = lambda p: (MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
    out, at = [], 0
    while at < len(pixels):
        n, d = 0, 0
        if references and (j := seen.get(tuple(pixels[at : at + 4]))) is not None:
            while at + n < len(pixels) and n < 4096 and pixels[j + n] == pixels[at + n]:
                n += 1
            d = at - j
        if n >= 4:
            out.append((at, "copy", n, d))
        elif cache_bits and store[key(pixels[at])] == pixels[at]:
            n = 1
            out.append((at, "cache", key(pixels[at])))
        else:
            n = 1
            out.append((at, "pixel", pixels[at]))
        for k in range(at, at + n):
            if cache_bits:
                store[key(pixels[k])] = pixels[k]
            if references:
                seen[tuple(pixels[k : k + 4])] = k
        at += n
    return out


def _write_image(sink: Sink, pixels: np.ndarray, main: bool, tools: Tools = Tools()) -> None:  # noqa: B008
    height, width = pixels.shape
    cache_bits, groups = (tools.cache_bits, tools.groups) if main else (0, False)
    sink.put(1 | cache_bits << 1, 5) if cache_bits else sink.put(0, 1)
    tokens = _tokens(pixels.ravel(), cache_bits, tools.references and main)
    of = lambda at: 0
    if main:
        sink.put(int(groups), 1)
        if groups:
            shift = tools.shift
            tiles = np.indices(((height + (1 << shift) - 1) >> shift, (width + (1 << shift) - 1) >> shift)).sum(axis=0) % 2
            sink.put(shift - 2, 3)
            _write_image(sink, (tiles.astype(np.uint32) << 8) | np.uint32(BLACK), False)
            of = lambda at: int(tiles[at // width >> shift, at % width >> shift])
    counts = [[Counter() for _ in range(5)] for _ in range(2 if groups and min(pixels.shape) and max(of(t[0]) for t in tokens) else 1)]
    places = {o: k + 1 for k, o in reversed([*enumerate(near_offsets())])}
    spelled = []
    for at, kind, *v in tokens:
        c = counts[of(at)]
        if kind == "pixel":
            a, r, g, b = (v[0] >> s & 255 for s in (24, 16, 8, 0))
            spell = [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif kind == "cache":
            spell = [(0, LITERALS + LENGTHS + v[0], 0, 0)]
        else:
            s, value, n = _prefix(v[0])
            dy, dx = divmod(v[1] + 7, width) if width > 15 else (99, 0)
            code = places.get((dx - 7, dy)) or v[1] + 120
            if _true_distance(code, width) != v[1]:
                code = v[1] + 120
            far, more, m = _prefix(code)
            spell = [(0, LITERALS + s, value, n), (4, far, more, m)]
        for k, s, _, _ in spell:
            c[k][s] += 1
        spelled.append((of(at), spell))
    codes = [[write_code(sink, code_lengths(c)) for c in group] for group in counts]
    for group, spell in spelled:
        for k, s, value, n in spell:
            sink.put(*codes[group][k][s])
            sink.put(value, n)
        if sink.n > 4096:
            sink._spill()


def _wrap(body: bytes) -> bytes:
    chunk = b"\x2f" + body
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


def _head(width: int, height: int) -> Sink:
    if not 0 < width <= 1 << 14 or not 0 < height <= 1 << 14:
        raise ValueError("a side must have 1 to 16384 pixels")
    sink = Sink()
    sink.put(width - 1 | height - 1 << 14 | 1 << 28, 32)
    return sink


def encode(pixels: np.ndarray, tools: Tools = Tools()) -> bytes:  # noqa: B008
    """(height, width) uint32 ARGB as a lossless WebP file."""
    height, width = pixels.shape
    sink = _head(width, height)
    now = pixels.astype(np.uint32)
    if tools.palette:
        table = np.unique(now)
        if len(table) > 256:
            raise ValueError("a palette has at most 256 colours")
        sink.put(1 | PALETTE << 1 | len(table) - 1 << 3, 11)
        _write_image(sink, _pixels(np.diff(_channels(table), axis=0, prepend=0))[None, :], False)
        shift = _bundle(len(table))
        index = np.searchsorted(table, now).astype(np.uint32)
        if shift:
            each = 8 >> shift
            index = np.pad(index, ((0, 0), (0, -width % (1 << shift)))).reshape(height, -1, 1 << shift)
            index = (index << (np.arange(1 << shift) * each).astype(np.uint32)).sum(axis=2, dtype=np.uint32)
        now = index << np.uint32(8) | np.uint32(BLACK)
    shape = tuple((n + (1 << tools.shift) - 1) >> tools.shift for n in now.shape)
    if tools.subtract_green:
        sink.put(1 | SUBTRACT_GREEN << 1, 3)
        now = _green(now, -1)
    if tools.predictor is not None:
        tiles = np.full(shape, BLACK | tools.predictor << 8, np.uint32)
        sink.put(1 | PREDICTOR << 1 | tools.shift - 2 << 3, 6)
        _write_image(sink, tiles, False)
        image = _channels(now)
        guess = np.stack([_predictions(image, y, _tile_modes(tiles, tools.shift, y, image.shape[1]), False) for y in range(len(image))])
        now = _pixels(image - guess)
    if tools.cross is not None:
        green_red, green_blue, red_blue = (v & 255 for v in tools.cross)
        tiles = np.full(shape, BLACK | red_blue << 16 | green_blue << 8 | green_red, np.uint32)
        sink.put(1 | CROSS_COLOUR << 1 | tools.shift - 2 << 3, 6)
        _write_image(sink, tiles, False)
        now = _cross(now, tiles, tools.shift, False)
    sink.put(0, 1)
    _write_image(sink, now, True, tools)
    return _wrap(sink.bytes())


# --- bytes as images ---------------------------------------------------------------------------

#: Samples of a row, and the rows of one image at most.
ROW, ROWS = 576, 1 << 14
#: Repeats shorter than this stay literals.
LEAST = 48


def repeats(payload: bytes, size: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that occurred before, and of one value repeated after ``size``."""
    found, seen, at = [], {}, 0
    if payload.count(b"\n", 0, size) > 1:
        for line in payload[:size].split(b"\n"):
            n = len(line)
            if n >= LEAST:
                d = at - seen.get(line, at)
                if 0 < d < 1 << 19:
                    found += [(at + k, min(4096, n - k), d) for k in range(0, n, 4096)]
                seen[line] = at
            at += n + 1
    if len(payload) - size > LEAST and payload.count(payload[size : size + 1], size) == len(payload) - size:
        found.append((size + 1, len(payload) - size - 1, 1))
    return found


@lru_cache(1024)
def _palette(colours: bytes) -> np.ndarray:
    """The bits of a palette of opaque greens: only green has a code with bits, and alpha its first 255."""
    sink = Sink()
    steps = [b - a for a, b in zip(b"\0" + colours, colours, strict=False)]
    sink.put(1 | PALETTE << 1 | len(colours) - 1 << 3, 11)
    sink.put(0, 1)
    green = write_code(sink, code_lengths(Counter(steps)))
    write_code(sink, {0: 1})
    write_code(sink, {0: 1})
    alpha = write_code(sink, {0: 1, 255: 1})
    write_code(sink, {0: 1})
    for k, step in enumerate(steps):
        sink.put(*green[step])
        sink.put(*alpha[0 if k else 255])
    sink._spill()
    return np.concatenate(sink.parts)


def _constant_runs(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, 1) of one value repeated, behind its first occurrence."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1, [len(flat)]])
    found = []
    for k in np.flatnonzero(np.diff(edges) > LEAST).tolist():
        start, end = int(edges[k]) + 1, int(edges[k + 1])
        found += [(at, min(4096, end - at), 1) for at in range(start, end, 4096)]
    return found


def _entropy(values: np.ndarray) -> float:
    """Bits that an ideal code by frequency takes for all ``values``."""
    counts = np.bincount(values, minlength=256)
    counts = counts[counts > 0]
    return float(counts @ np.log2(len(values) / counts))


def _cheapest(index: np.ndarray) -> tuple[int | None, np.ndarray]:
    """The predictor mode (None, 1: left, 2: top) whose residuals cost least, and the residuals."""
    left = index.copy()
    left[:, 1:] -= index[:, :-1]
    left[1:, 0] -= index[:-1, 0]
    top = index.copy()
    top[1:] -= index[:-1]
    top[0] = left[0]
    # A predictor has to pay for its header and for the back-references that it spoils.
    choices = [(_entropy(index.ravel()), 0, None, index), (_entropy(left.ravel()) * 1.05 + 64, 1, 1, left), (_entropy(top.ravel()) * 1.05 + 64, 2, 2, top)]
    return min(choices, key=lambda c: c[:2])[2:]


def encode_payload(payload: bytes, size: int | None = None) -> bytes:
    """Bytes (a positive multiple of ``ROW``) as palette images; ``size`` of them precede padding.

    Each sample is one pixel; samples of up to 16 values are bundled, 2, 4 or 8 a pixel. Pixels get
    Huffman codes, a spatial predictor where its residuals cost less, and back-references for lines
    that occurred before and for runs of one value. Red and blue are constant, so cross-colour has
    nothing to do, and a colour cache could only split one symbol in two, which never takes fewer
    bits. Payloads over ``ROW * ROWS`` bytes become several files in a row.
    """
    most = ROW * ROWS
    if len(payload) > most:
        return b"".join(encode_payload(payload[at : at + most], None if size is None else min(max(size - at, 0), len(payload[at : at + most]))) for at in range(0, len(payload), most))
    raw = np.frombuffer(payload, np.uint8)
    height = len(raw) // ROW
    sink = _head(ROW, height)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    sink.bits(_palette(used.astype(np.uint8).tobytes()))
    rank = np.zeros(256, np.uint8)
    rank[used] = np.arange(len(used))
    index = rank[raw].reshape(height, ROW)
    shift = _bundle(len(used))
    if shift:
        each = 8 >> shift
        index = (index.reshape(height, -1, 1 << shift) << (np.arange(1 << shift) * each).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    mode, flat = _cheapest(index)
    flat = flat.ravel()
    found = _constant_runs(flat) if shift or mode else repeats(payload, len(payload) if size is None else size)
    alpha = 255
    if mode:
        sink.put(1 | PREDICTOR << 1 | 7 << 3, 6)
        _write_image(sink, np.full((height + 511 >> 9, index.shape[1] + 511 >> 9), BLACK | mode << 8, np.uint32), False)
        alpha = 0  # the predicted alpha of every pixel is right
    sink.put(0, 3)  # no more transforms, no colour cache, one group
    copies = [(at, n, _prefix(n), _prefix(d + 120)) for at, n, d in found]
    literal = np.ones(len(flat), bool)
    for at, n, *_ in copies:
        literal[at : at + n] = False
    counts = Counter({s: c for s, c in enumerate(np.bincount(flat[literal]).tolist()) if c})
    counts.update(LITERALS + p[0] for *_, p, _ in copies)
    if len(counts) == 1:  # a code without bits would leave the reader nothing to walk
        counts[1 - min(1, *counts)] += 1
    lengths = code_lengths(counts, 12)
    code = write_code(sink, lengths)
    for s in (0, 0, alpha):
        write_code(sink, {s: 1})
    far_code = write_code(sink, code_lengths(Counter(q[0] for *_, q in copies)))
    word, bits = np.zeros(256, np.uint16), np.zeros(256, np.int64)
    for s, (value, n) in code.items():
        if s < LITERALS:
            word[s], bits[s] = value, n

    def literals(start: int, end: int) -> None:
        for lo in range(start, end, 1 << 16):
            part = flat[lo : min(end, lo + (1 << 16))]
            n = bits[part]
            ends = np.cumsum(n)
            within = np.arange(ends[-1]) - np.repeat(ends - n, n)
            sink.bits((np.repeat(word[part], n) >> within.astype(np.uint16) & 1).astype(np.uint8))

    at = 0
    for place, n, (s, value, m), (t, more, k) in copies:
        literals(at, place)
        sink.put(*code[LITERALS + s])
        sink.put(value, m)
        sink.put(*far_code[t])
        sink.put(more, k)
        at = place + n
    literals(at, len(flat))
    return _wrap(sink.bytes())


def images(data: bytes) -> list[bytes]:
    """The single files of a row of files."""
    out = []
    while data:
        n = 8 + struct.unpack("<I", data[4:8])[0]
        out.append(data[:n])
        data = data[n:]
    return out


def decode_payload(data: bytes) -> np.ndarray:
    """The samples that ``encode_payload`` stored."""
    return np.concatenate([(decode(one) >> 8 & 255).astype(np.uint8).ravel() for one in images(data)])
