"""Media columns: lossless WebP (VP8L) written and read without an image library.

decode() reads any lossless WebP still image: prefix codes (simple, normal, grouped by an entropy image), back
references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms; it returns the
pixel array. A pixel's symbols are looked up for every bit of a block of the stream at once, as if a pixel began there,
and then only the true beginnings are followed; images with several groups of codes are read symbol by symbol.

encode() writes what decode() reads: a palette where there are at most 16 colours, else the left predictor
where it lowers the samples' entropy, back references to the nearest place with the same two pixels, a colour cache,
and prefix codes fitted to the image.

store_texts() keeps a text's UTF-8 bytes as the samples of images 16 pixels wide, four to a pixel, reads the stored
bytes back with decode() and computes features of what it read.

Defined cases: a null or empty text is 64 bytes of 0; a text of any length is stored whole, as several images in a
row beyond 1 MiB; equal texts get equal values; repeated rows get equal rows; an empty table gives no rows; other
columns are ignored, so their names may clash with the result's.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices

#: Samples to a row of pixels, and rows to an image.
WIDTH, SIDE = 64, 16384
PREDICT, CROSS, GREEN, PALETTE = 0, 1, 2, 3
#: Fixed values of the format: the order in which lengths of the code for code lengths are stored; the hash factor; the
#: pixels (to the left, above) that short distances name.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Bits of the stream that are looked up at once.
BLOCK = 1 << 16
#: The longest code that encode() makes, the most colours of its palettes and the longest reference.
LIMIT, COLOURS, LONGEST = 11, 16, 4096


def _reversed_bits(n: int) -> np.ndarray:
    """Each number below 2^n with its n bits in the opposite order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


_REVERSED = [_reversed_bits(n) for n in range(16)]


class Bits:
    """Reads bits from the least significant on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, len(data) * 8

    def peek(self, n: int) -> int:
        """The next n bits, zeros beyond the end."""
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        found = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return found


class Code:
    """A canonical prefix code, from code lengths by symbol.

    `table` has, for each number of as many bits as the longest code, read from the stream: 16 x symbol + length.
    """

    def __init__(self, lengths: Sequence[int] | np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("not a complete prefix code")
        sizes = lengths[used]
        order = np.argsort(sizes, kind="stable")
        self.order, self.sizes = used[order], sizes[order]
        if len(used) == 1:
            self.bits, self.starts, self.spans = 0, np.zeros(1, np.int64), np.ones(1, np.int64)
            return
        self.bits = int(self.sizes[-1])
        self.spans = np.left_shift(1, self.bits - self.sizes)
        ends = np.cumsum(self.spans)
        self.starts = ends - self.spans
        if int(ends[-1]) != 1 << self.bits:
            raise ValueError("not a complete prefix code")

    @functools.cached_property
    def table(self) -> np.ndarray:
        if not self.bits:
            return 16 * self.order
        return np.repeat(16 * self.order + self.sizes, self.spans)[_REVERSED[self.bits]]

    def codes(self) -> list[tuple[int, int, int]]:
        """(symbol, length, code) in the order of codes."""
        sizes = self.sizes if len(self.order) > 1 else np.array([0])
        return [(int(s), int(n), int(c) >> (self.bits - int(n))) for s, n, c in zip(self.order, sizes, self.starts, strict=True)]

    def read(self, bits: Bits) -> int:
        found = int(self.table[bits.peek(self.bits)])
        bits.at += found & 15
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return found >> 4


@functools.lru_cache(256)
def _meta_table(sizes: tuple[int, ...]) -> tuple[list[int], int]:
    code = Code(sizes)
    return code.table.tolist(), (1 << code.bits) - 1


def _read_lengths(bits: Bits, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if bits.read(1):  # a simple code of one or two symbols
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        out[first] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    sizes = [0] * 19
    many = 4 + bits.read(4)
    held = bits.read(3 * many)
    for k in range(many):
        sizes[ORDER[k]] = held >> 3 * k & 7
    table, mask = _meta_table(tuple(sizes))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    found, n, last = [], 0, 8
    while n < size and left > 0:
        # The next 1024 bits as one number, from which some tokens are taken.
        held, begin = bits.peek(1024), 1024
        while n < size and left > 0 and begin > 32:
            left -= 1
            entry = table[held & mask]
            s, used = entry >> 4, entry & 15
            held >>= used
            if s < 16:
                found.append(s)
                n += 1
                last = s or last
            else:
                value, base, more = (last, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
                count = base + (held & ((1 << more) - 1))
                held >>= more
                used += more
                n += count
                found += [value] * count
            begin -= used
            bits.at += used
    if n > size or bits.at > bits.end:
        raise ValueError("too many code lengths")
    out[:n] = found
    return out


def _read_codes(bits: Bits, sizes: Sequence[int]) -> list[Code]:
    """A group's codes. One whose bits are those of the one before, for as many symbols, is the same code."""
    out: list[Code] = []
    written, n, last = 0, 0, 0
    for size in sizes:
        if out and size == last and bits.peek(n) == written:
            out.append(out[-1])
            bits.at += n
            continue
        begin, last = bits.at, size
        out.append(Code(_read_lengths(bits, size)))
        n, bits.at = bits.at - begin, begin
        written = bits.peek(n)
        bits.at += n
    return out


def _prefix_value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, which, shift, across = 1, None, 0, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        which = (_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    sink = _Sink(width, width * height, cache_bits)
    if which is None:
        _read_blocks(bits, codes[0], sink)
    else:
        while len(sink.out) < sink.total:
            at = len(sink.out)
            green, red, blue, alpha, far = codes[which[(at // width >> shift) * across + (at % width >> shift)]]
            s = green.read(bits)
            if s < 256:
                r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
                sink.literal(a << 24 | r << 16 | s << 8 | b)
            elif s < 280:
                n = _prefix_value(bits, s - 256)
                sink.copy(n, _prefix_value(bits, far.read(bits)))
            else:
                sink.cached(s - 280)
    return np.array(sink.out, np.uint32)


class _Sink:
    """The pixels so far, and the colour cache."""

    def __init__(self, width: int, total: int, cache_bits: int):
        self.width, self.total, self.shift = width, total, 32 - cache_bits
        self.out: list[int] = []
        self.cache = [0] * (1 << cache_bits) if cache_bits else None

    def literal(self, p: int) -> None:
        self.out.append(p)
        if self.cache is not None:
            self.cache[(HASH * p & 0xFFFFFFFF) >> self.shift] = p

    def cached(self, slot: int) -> None:
        if self.cache is None:
            raise ValueError("there is no colour cache")
        self.literal(self.cache[slot])  # a slot that was never filled holds 0, whose own slot may be another

    def copy(self, n: int, far: int) -> None:
        """`n` pixels from a place named by its distance code."""
        out = self.out
        if far > 120:
            far -= 120
        else:
            x, y = NEAR[far - 1]
            far = max(1, x + y * self.width)
        begin = len(out) - far
        if begin < 0 or len(out) + n > self.total:
            raise ValueError("a reference leaves the image")
        part = out[begin : begin + n]
        while len(part) < n:  # it reaches into itself
            part += part[: n - len(part)]
        out += part
        if self.cache is not None:
            for p in part:
                self.cache[(HASH * p & 0xFFFFFFFF) >> self.shift] = p


def _read_blocks(bits: Bits, codes: list[Code], sink: _Sink) -> None:
    """The pixels of one group of codes.

    For each bit of a block: what symbols a pixel would have that began there, and where the next one would begin.
    """
    green, red, blue, alpha, far = codes
    source = np.frombuffer(bits.data + bytes(16), np.uint8)
    out, cache, total, shift = sink.out, sink.cache, sink.total, np.uint32(sink.shift & 31)
    while len(out) < total:
        first = bits.at >> 3
        part = source[first : first + (BLOCK >> 3) + 16].astype(np.intp)
        if len(part) < 16:
            raise ValueError("the stream ends early")
        words = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16
        window = (words[:, None] >> np.arange(8)).ravel()
        here = np.arange(max(0, len(window) - 64))  # room for all of a literal's four codes of up to 15 bits
        every = np.arange(len(window))
        nexts: dict[int, np.ndarray] = {}

        def follows(code: Code, window=window, every=every, nexts=nexts) -> np.ndarray:
            """Where the next code begins, if this one begins at each bit."""
            if id(code) not in nexts:
                nexts[id(code)] = every + (code.table & 15).take(window & ((1 << code.bits) - 1))
            return nexts[id(code)]

        g = green.table.take(window[: len(here)] & ((1 << green.bits) - 1))
        after = [here + (g & 15)]
        for code in (red, blue, alpha):
            after.append(follows(code).take(after[-1]) if code.bits else after[-1])
        s = g >> 4
        starts = np.where(s < 256, after[3], after[0])
        starts[(s - 256).view(np.uint64) < 24] = -1  # a reference, read on its own
        follow = memoryview(starts)
        at, room, seen, jumps, limit = bits.at - 8 * first, total - len(out), [], [], len(here)
        see = seen.append
        stop = min(limit, bits.end - 8 * first) if green.bits else limit
        while at < stop:
            see(at)
            if (nxt := follow[at]) >= 0:
                at = nxt
                if len(seen) < room:
                    continue
            else:
                bits.at = 8 * first + int(after[0][at])
                n = _prefix_value(bits, int(s[at]) - 256)
                jumps.append((n, _prefix_value(bits, far.read(bits))))
                room -= n - 1
                at = bits.at - 8 * first
            if len(seen) >= room:
                break
        bits.at = 8 * first + at
        if bits.at > bits.end or not seen:
            raise ValueError("the stream ends early")
        where = np.array(seen, np.int64)
        kinds = s[where]
        lit = [(code.table.take(window.take(after[k][where]) & ((1 << code.bits) - 1)) >> 4).astype(np.uint32) for k, code in enumerate((red, blue, alpha))]
        pixels = lit[2] << np.uint32(24) | lit[0] << np.uint32(16) | (kinds & 255).astype(np.uint32) << np.uint32(8) | lit[1]
        jump = iter(jumps)
        if cache is None:
            for k, p in zip(kinds.tolist(), pixels.tolist(), strict=True):
                if k < 256:
                    out.append(p)
                elif k < 280:
                    sink.copy(*next(jump))
                else:
                    sink.cached(0)
            continue
        put = out.append
        for k, p, slot in zip(kinds.tolist(), pixels.tolist(), (np.uint32(HASH) * pixels >> shift).tolist(), strict=True):
            if k < 256:
                put(p)
                cache[slot] = p
            elif k < 280:
                sink.copy(*next(jump))
            else:
                sink.cached(k - 280)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _bytes(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _full(left: int, top: int, corner: int) -> int:
    return _join(_clamp(x + y - z) for x, y, z in zip(_bytes(left), _bytes(top), _bytes(corner), strict=True))


def _half(a: int, b: int) -> int:
    return _join(_clamp(x + int((x - y) / 2)) for x, y in zip(_bytes(a), _bytes(b), strict=True))


def _select(left: int, top: int, corner: int) -> int:
    near_left = sum(abs(t - c) for t, c in zip(_bytes(top), _bytes(corner), strict=True))
    near_top = sum(abs(x - c) for x, c in zip(_bytes(left), _bytes(corner), strict=True))
    return left if near_left < near_top else top


#: Mode number to the prediction from left, top, top right and top left.
PREDICTORS = (
    lambda le, t, tr, tl: 0xFF000000,
    lambda le, t, tr, tl: le,
    lambda le, t, tr, tl: t,
    lambda le, t, tr, tl: tr,
    lambda le, t, tr, tl: tl,
    lambda le, t, tr, tl: _average(_average(le, tr), t),
    lambda le, t, tr, tl: _average(le, tl),
    lambda le, t, tr, tl: _average(le, t),
    lambda le, t, tr, tl: _average(tl, t),
    lambda le, t, tr, tl: _average(t, tr),
    lambda le, t, tr, tl: _average(_average(le, tl), _average(t, tr)),
    lambda le, t, tr, tl: _select(le, t, tl),
    lambda le, t, tr, tl: _full(le, t, tl),
    lambda le, t, tr, tl: _half(_average(le, t), tl),
    lambda le, t, tr, tl: 0xFF000000,
    lambda le, t, tr, tl: 0xFF000000,
)


def _predicted(out: list[int], at: int, x: int, width: int, mode: int) -> int:
    if at == 0:
        return 0xFF000000
    if at < width:
        return out[at - 1]
    if x == 0:
        return out[at - width]
    return PREDICTORS[mode](out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return _join((x - y) & 255 for x, y in zip(_bytes(a), _bytes(b), strict=True))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8).view(np.int8).astype(np.int32)


def _by_block(blocks: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    """Each pixel's value of a transform's small image."""
    across = (width + (1 << shift) - 1) >> shift
    y, x = np.divmod(np.arange(width * height), width)
    return blocks[(y >> shift) * across + (x >> shift)]


def _undo_predict(pixels: np.ndarray, width: int, height: int, shift: int, blocks: np.ndarray) -> np.ndarray:
    if (blocks >> 8 & 15 == blocks[0] >> 8 & 15).all() and (mode := int(blocks[0]) >> 8 & 15) in (1, 2):
        # Sums from the left, or from above; the first pixel counts from black, the first row and column from what is there.
        parts = pixels.view(np.uint8).reshape(height, width, 4).copy()
        parts[0, 0, 3:] -= np.uint8(1)  # and 255
        edge, rest = (parts[:, 0], 1) if mode == 1 else (parts[0], 0)
        np.cumsum(edge, axis=0, dtype=np.uint8, out=edge)
        return np.cumsum(parts, axis=rest, dtype=np.uint8).reshape(-1, 4).copy().view(np.uint32).ravel()
    modes = (_by_block(blocks, width, height, shift) >> 8 & 15).tolist()
    out = pixels.tolist()
    for at in range(width * height):
        out[at] = _add(out[at], _predicted(out, at, at % width, width, modes[at]))
    return np.array(out, np.uint32)


def _undo_cross(pixels: np.ndarray, width: int, height: int, shift: int, blocks: np.ndarray) -> np.ndarray:
    t = _by_block(blocks, width, height, shift)
    green = _signed(pixels >> 8)
    red = (pixels >> 16 & 255).astype(np.int32) + (_signed(t) * green >> 5)
    blue = (pixels & 255).astype(np.int32) + (_signed(t >> 8) * green >> 5) + (_signed(t >> 16) * _signed(red & 255) >> 5)
    return pixels & np.uint32(0xFF00FF00) | (red & 255).astype(np.uint32) << 16 | (blue & 255).astype(np.uint32)


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)


def _undo_palette(pixels: np.ndarray, width: int, height: int, packed: int, table: np.ndarray) -> np.ndarray:
    per, across = 1 << packed, (width + (1 << packed) - 1) >> packed
    index = pixels >> 8 & 255
    if packed:
        size = 8 >> packed
        parts = index[:, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)
        index = parts.reshape(height, across * per)[:, :width].ravel()
    return np.concatenate((table, np.zeros(256, np.uint32)))[index]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels of the lossless WebP file at the start of `data`, ARGB in height x width, and the file's length."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless bitstream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            shift = bits.read(3) + 2
            blocks = _pixels(bits, (now + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
            undo.append((_undo_predict if kind == PREDICT else _undo_cross, (now, height, shift, blocks)))
        elif kind == GREEN:
            undo.append((_undo_green, ()))
        else:
            n = bits.read(8) + 1
            steps = _pixels(bits, n, 1, False)
            table = sum((np.cumsum(steps >> s & 255) & 255).astype(np.uint32) << s for s in (0, 8, 16, 24))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_undo_palette, (now, height, packed, table)))
            now = (now + (1 << packed) - 1) >> packed
    pixels = _pixels(bits, now, height, True)
    for step, args in reversed(undo):
        pixels = step(pixels, *args)
    return pixels.reshape(height, width), end


# Writing.


class Writer:
    """Bits from the least significant on, as one number."""

    def __init__(self):
        self.value, self.size = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= int(value) << self.size
        self.size += n

    def code(self, value: int, n: int) -> None:
        """A code, whose first bit is its greatest."""
        self.bits(int(_REVERSED[n][value]), n)

    def items(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers of at most 64 bits each."""
        if not len(values):
            return
        at = np.cumsum(sizes) - sizes
        n = int(at[-1] + sizes[-1])
        words = np.zeros((n >> 6) + 2, np.uint64)
        place, low = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, place, values << low)
        np.bitwise_or.at(words, place + 1, np.where(low > 0, values >> (np.uint64(64) - np.maximum(low, np.uint64(1))), np.uint64(0)))
        self.bits(int.from_bytes(words.astype("<u8").tobytes(), "little"), n)

    def to_bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) >> 3, "little")


def _riff(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * pad


def _head(w: Writer, width: int, height: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.bits(value, n)


def _one(w: Writer, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    w.bits(1, 1)
    w.bits(0, 1)
    w.bits(int(symbol > 1), 1)
    w.bits(symbol, 8 if symbol > 1 else 1)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a complete prefix code: each symbol's information rounded up, and what that leaves given to the most frequent."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(-counts[used], kind="stable")]
    limit = max(limit, int(len(used) - 1).bit_length())
    sizes = np.clip(np.ceil(np.log2(counts.sum() / counts[order])), 1, limit).astype(np.int64).tolist()
    left = (1 << limit) - sum(1 << (limit - n) for n in sizes)
    k = len(sizes) - 1
    while left < 0:  # rare symbols were cut to the limit: the least frequent ones that are shorter grow
        if sizes[k] < limit:
            left += 1 << (limit - sizes[k] - 1)
            sizes[k] += 1
        else:
            k -= 1
    while left:
        for k, n in enumerate(sizes):
            if n > 1 and 1 << (limit - n) <= left:
                left -= 1 << (limit - n)
                sizes[k] = n - 1
    out[order] = sizes
    return out


#: The code for code lengths that encode() writes: 13 symbols of four bits and 6 of five.
_META = [5 if k in (1, 2, 12, 13, 14, 15) else 4 for k in range(19)]
_META_CODES = {s: (int(_REVERSED[n][c]), n) for s, n, c in Code(_META).codes()}
_META_HEAD = Writer()
for _value, _size in ((0, 1), (15, 4), *((_META[_s], 3) for _s in ORDER), (0, 1)):
    _META_HEAD.bits(_value, _size)


def _write_lengths(w: Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code's lengths; gives each symbol's code, as its bits stand in the stream, and size."""
    used = np.flatnonzero(lengths)
    sizes = np.zeros(len(lengths), np.int64)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        _one(w, int(used[0]) if len(used) else 0)
        return np.zeros(len(lengths), np.uint64), sizes
    w.bits(_META_HEAD.value, _META_HEAD.size)
    edges = np.flatnonzero(np.concatenate(([True], lengths[1:] != lengths[:-1], [True])))
    value = size = 0
    for length, n in zip(lengths[edges[:-1]].tolist(), np.diff(edges).tolist(), strict=True):
        tokens = []
        if length:
            tokens, n = [(length, 0, 0)], n - 1
            while n >= 3:
                tokens.append((16, min(n, 6) - 3, 2))
                n -= min(n, 6)
        else:
            while n >= 11:
                tokens.append((18, min(n, 138) - 11, 7))
                n -= min(n, 138)
            if n >= 3:
                tokens.append((17, n - 3, 3))
                n = 0
        for s, extra, more in (*tokens, *[(length, 0, 0)] * n):
            code, bits = _META_CODES[s]
            value |= (code | extra << bits) << size
            size += bits + more
    w.bits(value, size)
    made = Code(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) > 1:
        out[made.order] = _REVERSED[made.bits][made.starts]
        sizes[made.order] = made.sizes
    return out, sizes


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths and distances from 1."""
    k = values - 1
    high = np.maximum(np.frexp(k.astype(np.float64))[1] - 1, 1)
    small = k < 4
    more = np.where(small, 0, high - 1)
    return np.where(small, k, 2 * high + (k >> np.maximum(more, 0) & 1)), np.where(small, 0, k & ((1 << more) - 1)), more


def _matches(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the distance to the nearest earlier one with the same two pixels, and how many are the same there; 0 if none."""
    n = len(flat)
    far, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 3:
        return far, length
    pairs = flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:]
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    # Places in a row with one distance are one match; it ends a pixel after the last of them.
    runs = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1], [True])))
    ends = np.repeat(runs[1:], np.diff(runs))
    length[far > 0] = np.minimum(ends - np.arange(n) + 1, LONGEST)[far > 0]
    return far, length


def _write_pixels(w: Writer, flat: np.ndarray, width: int, main: bool) -> None:
    """An entropy-coded image: one group of codes, references, and a colour cache."""
    n = len(flat)
    cache_bits = max(1, min(8, n.bit_length() - 2))
    w.bits(1, 1)
    w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    far, length = _matches(flat)
    steps, at, seen = memoryview(np.maximum(length, 1)), 0, []
    while at < n:
        seen.append(at)
        at += steps[at]
    where = np.array(seen)
    # A colour is in the cache if the last pixel with its slot has it.
    slot = (np.uint32(HASH) * flat >> np.uint32(32 - cache_bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    known = np.zeros(n, bool)
    known[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
    copied, cached = length[where] > 0, known[where]
    lit, jump = np.flatnonzero(~(copied | cached)), np.flatnonzero(copied)
    p = flat[where[lit]].view(np.uint8).reshape(-1, 4)
    channels = [p[:, k] for k in (1, 2, 0, 3)]  # green, red, blue, alpha
    prefix, extra, more = _prefixes(length[where[jump]])
    green = 280 + slot[where]
    green[lit], green[jump] = channels[0], 256 + prefix
    d, near = far[where[jump]], _near(width)
    named = np.where(d < len(near), near[np.minimum(d, len(near) - 1)], 0)
    far_prefix, far_extra, far_more = _prefixes(np.where(named > 0, named, d + 120))
    # Red, blue and alpha share the lengths of their codes, unless each has a single value.
    others = [np.bincount(c, minlength=256) for c in channels[1:]]
    if any((c > 0).sum() > 1 for c in others):
        others = [sum(others)] * 3
    written: dict[int, tuple] = {}
    codes = []
    for c in (np.bincount(green, minlength=280 + (1 << cache_bits)), *others, np.bincount(far_prefix, minlength=40)):
        if id(c) not in written:
            own = Writer()
            codes.append(_write_lengths(own, code_lengths(c)))
            written[id(c)] = codes[-1], own
        else:
            codes.append(written[id(c)][0])
        w.bits(written[id(c)][1].value, written[id(c)][1].size)
    value, size = codes[0][0][green], codes[0][1][green]
    v, n = value[lit], size[lit]
    for (code, bits), c in zip(codes[1:4], channels[1:], strict=True):
        v |= code[c] << n.astype(np.uint64)
        n += bits[c]
    value[lit], size[lit] = v, n
    v, n = value[jump], size[jump]
    for number, bits in ((extra, more), (codes[4][0][far_prefix], codes[4][1][far_prefix]), (far_extra, far_more)):
        v |= number.astype(np.uint64) << n.astype(np.uint64)
        n += bits
    value[jump], size[jump] = v, n
    w.items(value, size)


@functools.cache
def _near(width: int) -> np.ndarray:
    """The short code of each distance that has one, else 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for k in range(len(NEAR) - 1, -1, -1):
        out[max(1, NEAR[k][0] + NEAR[k][1] * width)] = k + 1
    return out


def _residuals(pixels: np.ndarray) -> np.ndarray:
    """What the left predictor leaves of the pixels."""
    parts = pixels.view(np.uint8).reshape(*pixels.shape, 4)
    out = parts.copy()
    out[:, 1:] -= parts[:, :-1]
    out[1:, 0] = parts[1:, 0] - parts[:-1, 0]
    out[0, 0, 3:] += np.uint8(1)  # less 255
    return out.reshape(-1, 4).view(np.uint32).reshape(pixels.shape)


def _entropy(pixels: np.ndarray) -> float:
    counts = np.bincount(pixels.view(np.uint8).ravel(), minlength=256)
    counts = counts[counts > 0]
    return float(counts @ np.log2(counts.sum() / counts))


def encode(pixels: np.ndarray) -> bytes:
    """A lossless WebP file of ARGB numbers in height x width."""
    height, width = pixels.shape
    pixels = np.ascontiguousarray(pixels, "<u4")
    w = Writer()
    _head(w, width, height)
    few = len(set(pixels.ravel()[: 4 * COLOURS].tolist())) <= COLOURS
    colours = np.unique(pixels) if few else None
    if few and len(colours) <= COLOURS:
        w.bits(1, 1)
        w.bits(PALETTE, 2)
        w.bits(len(colours) - 1, 8)
        parts = colours.view(np.uint8).reshape(-1, 4)
        _write_pixels(w, (parts - np.concatenate((np.zeros((1, 4), np.uint8), parts[:-1]))).view("<u4").ravel(), len(colours), False)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        per, bits = 1 << packed, 8 >> packed
        index = np.zeros((height, -(-width // per) * per), np.uint32)
        index[:, :width] = np.searchsorted(colours, pixels)
        grouped = (index.reshape(height, -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(bits))).sum(axis=2, dtype=np.uint32)
        pixels, width = np.uint32(0xFF000000) | grouped << np.uint32(8), grouped.shape[1]
    else:
        left = _residuals(pixels)
        if _entropy(left) < 0.97 * _entropy(pixels):
            w.bits(1, 1)
            w.bits(PREDICT, 2)
            w.bits(7, 3)  # blocks of 512 pixels
            _write_pixels(w, np.full(-(-width // 512) * -(-height // 512), 0xFF000100, np.uint32), -(-width // 512), False)
            pixels = left
    w.bits(0, 1)
    _write_pixels(w, pixels.ravel(), width, True)
    return _riff(w.to_bytes())


def encode_samples(payload: bytes) -> bytes:
    """Images of 64 x n samples, four to a pixel (blue, green, red, alpha), one to a MiB."""
    return b"".join(encode(np.frombuffer(payload[at : at + WIDTH * SIDE], "<u4").reshape(-1, WIDTH // 4)) for at in range(0, len(payload), WIDTH * SIDE))


def decode_samples(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        pixels, n = decode(data[at : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
        out.append(pixels.astype("<u4").tobytes())
        at += n
    return b"".join(out)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes with zeros up to a positive multiple of 64, and their number without."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def features(payload: bytes) -> str:
    """Mean, entropy in bits, distinct values and share of ASCII letters of what was read back."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = float(np.arange(256) @ counts) / len(payload)
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    return f"mean={mean:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};distinct={len(p)};letters={letters / len(payload):.4f}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per document: sizes, digests of the payload read back and of the stored form, features; with keep_media the stored bytes too."""

    def stored(text: str | None) -> tuple:
        payload, n = payload_of(text)
        media = encode_samples(payload)
        back = decode_samples(media)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back), media if keep_media else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = functools.lru_cache(1024)(stored)  # copies of a text often stand together
        for batch in slices(batches, "_text", 1 << 20):
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column("_text").to_pylist():
                for c, v in zip(cols, recent(text) if len(text or "") < 1 << 14 else stored(text), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: 8 if keep_media else 7]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] * keep_media)]
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media)
