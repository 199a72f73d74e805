"""Lossless WebP: a decoder of the whole format, and a batch writer and reader of grey images.

``decode`` reads any VP8L stream (RFC 9649): prefix codes, back-references, colour cache, entropy images, and the
predictor, cross-colour, subtract-green and palette transforms. ``write_grey`` and ``read_grey`` carry many grey images at once; reading
advances all images of a group by one symbol a step, as array operations.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

# --- fixed values of the format ---------------------------------------------------------------
SIGNATURE = 0x2F
LENGTH_CODES, DISTANCE_CODES, LITERALS = 24, 40, 256
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Mode of the predictor: the pixel to the left.
LEFT = 1
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
# (x to the left, y above) of the first distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2),
    (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2),
    (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6),
    (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class WebPError(ValueError):
    """The bytes are no lossless WebP image."""


# --- prefix codes ------------------------------------------------------------------------------


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data + bytes(8), at, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebPError("the stream ends too early")
        return value


def _reversal(bits: int) -> np.ndarray:
    index = np.arange(1 << bits)
    out = np.zeros_like(index)
    for i in range(bits):
        out |= (index >> i & 1) << (bits - 1 - i)
    return out


_REVERSED = [_reversal(b) for b in range(16)]


def lookup(lengths: np.ndarray, bits: int) -> np.ndarray:
    """For every value of the next ``bits`` bits: symbol * 16 + code length.

    Canonical codes in order of length and symbol fill the table from its start, each 2 ** (bits - length) entries, when
    read from the most significant bit; the stream has them reversed.
    """
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.full(1 << bits, int(used[0]) * 16, np.int32)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = 1 << (bits - lengths[order])
    if sizes.sum() != 1 << bits:
        raise WebPError("a prefix code is incomplete or oversubscribed")
    return np.repeat(order * 16 + lengths[order], sizes)[_REVERSED[bits]].astype(np.int32)


@dataclass
class Prefix:
    """One prefix code: its lengths, and the symbol where only one exists."""

    lengths: np.ndarray
    only: int | None
    bits: int
    table: list[int] | None = None

    def read(self, stream: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = lookup(self.lengths, self.bits).tolist()
        entry = self.table[stream.peek(self.bits)]
        stream.at += entry & 15
        return entry >> 4


def _prefix(lengths: np.ndarray) -> Prefix:
    used = np.flatnonzero(lengths)
    if not len(used):
        raise WebPError("a prefix code has no symbol")
    return Prefix(lengths, int(used[0]) if len(used) == 1 else None, int(lengths.max()))


def read_prefix(stream: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if stream.read(1):
        count = stream.read(1) + 1
        symbols = [stream.read(8 if stream.read(1) else 1)]
        if count == 2:
            symbols.append(stream.read(8))
        if max(symbols) >= alphabet:
            raise WebPError("a symbol lies outside its alphabet")
        lengths[symbols] = 1
        return _prefix(lengths)
    outer = np.zeros(19, np.int64)
    for i in range(4 + stream.read(4)):
        outer[CODE_LENGTH_ORDER[i]] = stream.read(3)
    code = _prefix(outer)
    tokens = 2 + stream.read(2 + 2 * stream.read(3)) if stream.read(1) else alphabet
    at, previous = 0, 8
    while at < alphabet and tokens:
        tokens -= 1
        token = code.read(stream)
        if token < 16:
            lengths[at] = token
            previous = token or previous
            at += 1
            continue
        value, run = (previous, 3 + stream.read(2)) if token == 16 else (0, 3 + stream.read(3)) if token == 17 else (0, 11 + stream.read(7))
        if at + run > alphabet:
            raise WebPError("a run of code lengths is too long")
        lengths[at : at + run] = value
        at += run
    return _prefix(lengths)


def _extended(symbol: int, stream: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + stream.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- coded images -------------------------------------------------------------------------------


@dataclass
class _Head:
    """What stands before the pixels of a coded image."""

    width: int
    height: int
    cache_bits: int
    groups: list[list[Prefix]]
    entropy: np.ndarray | None
    entropy_bits: int


def _read_head(stream: Bits, width: int, height: int, main: bool) -> _Head:
    cache_bits = stream.read(4) if stream.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    entropy, bits, count = None, 0, 1
    if main and stream.read(1):
        bits = stream.read(3) + 2
        entropy = (_coded_image(stream, -(-width >> bits), -(-height >> bits)) >> 8) & 0xFFFF
        count = int(entropy.max()) + 1
    green = LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    groups = [[read_prefix(stream, n) for n in (green, 256, 256, 256, DISTANCE_CODES)] for _ in range(count)]
    return _Head(width, height, cache_bits, groups, entropy, bits)


def _read_pixels(stream: Bits, head: _Head) -> np.ndarray:
    width, total = head.width, head.width * head.height
    out: list[int] = []
    cache = [0] * (1 << head.cache_bits)
    shift = 32 - head.cache_bits
    group = head.groups[0]
    while len(out) < total:
        if head.entropy is not None:
            y, x = divmod(len(out), width)
            group = head.groups[int(head.entropy[y >> head.entropy_bits, x >> head.entropy_bits])]
        symbol = group[0].read(stream)
        if symbol < LITERALS:
            red, blue, alpha = group[1].read(stream), group[2].read(stream), group[3].read(stream)
            new = [alpha << 24 | red << 16 | symbol << 8 | blue]
        elif symbol < LITERALS + LENGTH_CODES:
            length = _extended(symbol - LITERALS, stream)
            distance = _distance(_extended(group[4].read(stream), stream), width)
            if distance > len(out) or len(out) + length > total:
                raise WebPError("a back-reference leaves the image")
            new = [out[len(out) - distance + i % distance] for i in range(length)]
        else:
            new = [cache[symbol - LITERALS - LENGTH_CODES]]
        if head.cache_bits:
            for pixel in new:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        out += new
        if stream.at > stream.end:
            raise WebPError("the stream ends too early")
    return np.array(out, np.uint32).reshape(head.height, width)


def _coded_image(stream: Bits, width: int, height: int) -> np.ndarray:
    return _read_pixels(stream, _read_head(stream, width, height, False))


# --- transforms ---------------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red and alpha of each pixel along a last axis."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        average = half(left, top)
        return np.clip(average + np.trunc((average - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([0, 0, 0, 255])


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    out = _channels(pixels).astype(np.int64)
    height, width = pixels.shape
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = out[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _predicted(int(modes[y >> bits, x >> bits] >> 8 & 0xF), out[y, x - 1], out[y - 1, x], corner, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + guess) & 255
    return _packed(out)


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int64)
    height, width = pixels.shape
    block = _channels(factors)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    out = _channels(pixels).astype(np.int64)
    green = signed(out[..., 1])
    red = (out[..., 2] + (signed(block[..., 0]) * green >> 5)) & 255
    blue = out[..., 0] + (signed(block[..., 1]) * green >> 5)
    out[..., 0] = (blue + (signed(block[..., 2]) * signed(red) >> 5)) & 255
    out[..., 2] = red
    return _packed(out)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    out = _channels(pixels).astype(np.int64)
    out[..., 0] = (out[..., 0] + out[..., 1]) & 255
    out[..., 2] = (out[..., 2] + out[..., 1]) & 255
    return _packed(out)


def undo_palette(pixels: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    """Indices stand in green, for small palettes several in one pixel, the lowest bits first."""
    packing = palette_packing(len(colours))
    green = pixels >> 8 & 0xFF
    each = 8 >> packing
    index = np.stack([green >> each * i & ((1 << each) - 1) for i in range(1 << packing)], -1).reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index]


def palette_packing(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _start(stream: Bits) -> tuple[int, int, list[tuple], int]:
    """Size, transforms and width of the coded image."""
    if stream.read(8) != SIGNATURE:
        raise WebPError("no signature")
    width, height = stream.read(14) + 1, stream.read(14) + 1
    stream.read(1)
    if stream.read(3):
        raise WebPError("unknown version")
    transforms, coded, seen = [], width, set()
    while stream.read(1):
        kind = stream.read(2)
        if kind in seen:
            raise WebPError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = stream.read(3) + 2
            transforms.append((kind, _coded_image(stream, -(-coded >> bits), -(-height >> bits)), bits))
        elif kind == PALETTE:
            size = stream.read(8) + 1
            deltas = _channels(_coded_image(stream, size, 1))[0].astype(np.int64)
            transforms.append((kind, _packed(np.cumsum(deltas, 0) & 255), coded))
            coded = -(-coded >> palette_packing(size))
        else:
            transforms.append((kind,))
    return width, height, transforms, coded


def _undo(pixels: np.ndarray, transforms: list[tuple]) -> np.ndarray:
    steps = {PREDICTOR: undo_predictor, CROSS_COLOUR: undo_cross_colour, SUBTRACT_GREEN: undo_subtract_green, PALETTE: undo_palette}
    for kind, *rest in reversed(transforms):
        pixels = steps[kind](pixels, *rest)
    return pixels


def decode_stream(data: bytes) -> np.ndarray:
    """Pixels of a VP8L stream: height x width x (red, green, blue, alpha), 8 bits each."""
    stream = Bits(data)
    _, height, transforms, coded = _start(stream)
    pixels = _read_pixels(stream, _read_head(stream, coded, height, True))
    return _channels(_undo(pixels, transforms))[..., [2, 1, 0, 3]]


def chunks(data: bytes) -> list[bytes]:
    """The VP8L streams of one or more WebP files, end to end; the frames of an animation stand for their images."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP" or len(data) < at + 20:
            raise WebPError("no WebP file")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            raise WebPError("a file ends too early")
        found = _streams(data, at + 12, end)
        if not found:
            raise WebPError("no lossless WebP file")
        out += found
        at = end
    return out


def _streams(data: bytes, at: int, end: int) -> list[bytes]:
    out = []
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise WebPError("a chunk ends too late")
        if name == b"VP8L":
            out.append(data[at + 8 : at + 8 + size])
        elif name == b"ANMF":
            out += _streams(data, at + 24, at + 8 + size)
        at += 8 + size + (size & 1)
    return out


def _chunk(name: bytes, content: bytes) -> bytes:
    return name + struct.pack("<I", len(content)) + content + bytes(len(content) & 1)


def file_of(stream: bytes) -> bytes:
    body = b"WEBP" + _chunk(b"VP8L", stream)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def stacked(streams: Sequence[bytes], width: int, rows: Sequence[int]) -> bytes:
    """One file of several images, each below the one before (which has an even number of rows): the frames of an animation that shows the whole at its end."""
    three = lambda n: n.to_bytes(3, "little")
    body = b"WEBP" + _chunk(b"VP8X", b"\x02\0\0\0" + three(width - 1) + three(sum(rows) - 1)) + _chunk(b"ANIM", b"\xff\xff\xff\xff\1\0")
    frames, top = [], 0
    for stream, n in zip(streams, rows, strict=True):
        frames.append(_chunk(b"ANMF", three(0) + three(top // 2) + three(width - 1) + three(n - 1) + three(0) + b"\2" + _chunk(b"VP8L", stream)))
        top += n
    body += b"".join(frames)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode(data: bytes) -> list[np.ndarray]:
    """Pixel arrays of all images of one or more files, end to end."""
    return [decode_stream(c) for c in chunks(data)]


# --- writing grey images ------------------------------------------------------------------------

#: Longest code that is written; also the bits that reading looks at.
LONGEST = 12
#: Code lengths of the code that the code lengths are written in: 0 to 12, 17 and 18.
_OUTER = np.array([4] * 13 + [0, 0, 0, 0, 3, 4], np.int64)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code of at most LONGEST bits, near to -log2 of each symbol's share."""
    counts = counts.copy()
    if np.count_nonzero(counts) < 2:  # a second symbol, so that no code is empty
        counts[np.flatnonzero(counts == 0)[:2]] += 1
    used = np.flatnonzero(counts)
    order = used[np.argsort(-counts[used], kind="stable")]
    lengths = np.clip(np.ceil(np.log2(counts.sum() / counts[order])), 1, LONGEST).astype(np.int64).tolist()
    room = (1 << LONGEST) - sum(1 << (LONGEST - n) for n in lengths)
    i = len(lengths) - 1
    while room < 0:  # the limit cost too much: lengthen the rarest that still can be
        if lengths[i] < LONGEST:
            room += 1 << (LONGEST - lengths[i] - 1)
            lengths[i] += 1
        else:
            i -= 1
    while room:
        for i, n in enumerate(lengths):
            if n > 1 and 1 << (LONGEST - n) <= room:
                room -= 1 << (LONGEST - n)
                lengths[i] = n - 1
    out = np.zeros(len(counts), np.int64)
    out[order] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits in stream order."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    starts = np.concatenate([[0], np.cumsum(1 << (LONGEST - lengths[order]))[:-1]])
    out = np.zeros(len(lengths), np.int64)
    out[order] = _REVERSED[LONGEST][starts]  # the low bits of the reversal are those of the shorter code
    return out


_OUTER_CODES = codes(_OUTER)


class _Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def _put_lengths(out: _Writer, lengths: np.ndarray) -> None:
    """One prefix code in the long form: runs of zeros by 17 and 18, other lengths as they are."""
    out.put(0, 1)
    out.put(16 - 4, 4)
    for symbol in CODE_LENGTH_ORDER[:16]:
        out.put(int(_OUTER[symbol]), 3)
    out.put(0, 1)

    def token(t: int) -> None:
        out.put(int(_OUTER_CODES[t]), int(_OUTER[t]))

    at = 0
    for symbol in [*np.flatnonzero(lengths).tolist(), len(lengths)]:
        gap = symbol - at
        while gap:
            if gap >= 11:
                run = min(gap, 138)
                token(18)
                out.put(run - 11, 7)
            elif gap >= 3:
                run = gap
                token(17)
                out.put(run - 3, 3)
            else:
                run = 1
                token(0)
            gap -= run
        if symbol < len(lengths):
            token(int(lengths[symbol]))
        at = symbol + 1


def _put_only(out: _Writer, symbol: int) -> None:
    out.put(1, 1)
    out.put(0, 1)
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


def _length_symbol(length: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a back-reference length."""
    d = length - 1
    if d < 4:
        return d, 0, 0
    high = d.bit_length() - 1
    return 2 * high + (d >> (high - 1) & 1), d & ((1 << (high - 1)) - 1), high - 1


def _entropy(counts: np.ndarray) -> float:
    """Bits of a string with these counts of symbols."""
    used = counts[counts > 0]
    total = int(used.sum())
    return total * math.log2(total) - float((used * np.log2(used)).sum()) if total else 0.0


#: Bits that a transform may cost and still be worth trying: a palette's colour, the two headers.
_COLOUR_BITS, _PALETTE_BITS, _PREDICTOR_BITS = 12, 120, 60


def _put_palette(out: _Writer, colours: np.ndarray) -> None:
    """The palette transform of grey colours in ascending order."""
    for value, n in ((1, 1), (PALETTE, 2), (len(colours) - 1, 8), (0, 1)):
        out.put(value, n)
    deltas = np.diff(colours.astype(np.int64), prepend=0)
    lengths = code_lengths(np.bincount(deltas, minlength=LITERALS + LENGTH_CODES))
    code = codes(lengths)
    _put_lengths(out, lengths)
    for _ in range(2):  # red and blue like green
        _put_lengths(out, lengths[:LITERALS])
    if len(colours) > 1:  # opaque, then no change
        alpha = np.zeros(LITERALS, np.int64)
        alpha[[0, 255]] = 1
        _put_lengths(out, alpha)
    else:
        _put_only(out, 255)
    _put_only(out, 0)
    for i, d in enumerate(deltas.tolist()):
        for _ in range(3):
            out.put(int(code[d]), int(lengths[d]))
        if len(colours) > 1:
            out.put(int(i == 0), 1)


def _put_predictor(out: _Writer) -> None:
    """Every pixel is predicted by the one to its left (the first of a row by the one above)."""
    for value, n in ((1, 1), (PREDICTOR, 2), (7, 3), (0, 1)):
        out.put(value, n)
    for symbol in (LEFT, 0, 0, 255, 0):
        _put_only(out, symbol)


def write_grey(samples: np.ndarray, offsets: np.ndarray, width: int) -> list[bytes]:
    """VP8L streams of many grey images: ``samples`` end to end, ``offsets`` in samples, each a multiple of ``width``.

    The form that is shortest by its entropy is written: subtract-green alone, with the left predictor before it, or,
    for images of at most 16 greys, a palette with two, four or eight pixels in one. In each, only green varies, so a pixel
    costs only its green code. A run of equal values at an image's end is one literal and a back-reference to the pixel before.
    """
    if not len(offsets) - 1:
        return []
    left = samples.copy()
    left[1:] -= samples[:-1]
    left[width::width] = samples[width::width] - samples[:-width:width]
    left[offsets[:-1]] = samples[offsets[:-1]]
    values, sizes, starts = [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        image = samples[a:b]
        rows = (b - a) // width
        counts = np.bincount(image, minlength=LITERALS + LENGTH_CODES)
        form, bits = "green", _entropy(counts)
        predicted = np.bincount(left[a:b], minlength=LITERALS + LENGTH_CODES)
        if (other := _entropy(predicted) + _PREDICTOR_BITS) < bits:
            form, bits = "left", other
        colours = np.flatnonzero(counts)
        if len(colours) <= 16:
            packing = palette_packing(len(colours))
            index = np.searchsorted(colours, image).reshape(rows, width)
            index = np.pad(index, ((0, 0), (0, -width % (1 << packing)))).reshape(rows, -1, 1 << packing)
            packed = (index << (8 >> packing) * np.arange(1 << packing)).sum(-1).astype(np.uint8).ravel()
            bundled = np.bincount(packed, minlength=LITERALS + LENGTH_CODES)
            if _entropy(bundled) + _COLOUR_BITS * len(colours) + _PALETTE_BITS < bits:
                form = "palette"
        plane, counts = {"green": (image, counts), "left": (left[a:b], predicted), "palette": (packed, bundled) if len(colours) <= 16 else (image, counts)}[form]
        tail = plane[-577:] != plane[-1]
        run = int(np.argmax(tail[::-1])) if tail.any() else len(tail)
        copy = run - 1 if run >= 4 else 0
        literal = plane[: len(plane) - copy]
        extra = _length_symbol(copy) if copy else None
        if extra:
            counts = np.bincount(literal, minlength=LITERALS + LENGTH_CODES)
            counts[LITERALS + extra[0]] += 1
        lengths = code_lengths(counts)
        code = codes(lengths)
        head = _Writer()
        for value, n in ((SIGNATURE, 8), (width - 1, 14), (rows - 1, 14), (0, 4)):
            head.put(value, n)
        if form == "palette":
            _put_palette(head, colours)
        else:
            head.put(1, 1)
            head.put(SUBTRACT_GREEN, 2)
            if form == "left":
                _put_predictor(head)
        for _ in range(3):  # no further transform, no colour cache, one group of codes
            head.put(0, 1)
        _put_lengths(head, lengths)
        for symbol in (0, 0, 0 if form == "left" else 255, 1):
            _put_only(head, symbol)
        words = np.frombuffer(head.value.to_bytes(-(-head.size // 16) * 2, "little"), "<u2").astype(np.uint64)
        word_sizes = np.full(len(words), 16)
        word_sizes[-1] = head.size - 16 * (len(words) - 1)
        v, s = [words, code[literal].astype(np.uint64)], [word_sizes, lengths[literal]]
        if extra:
            symbol = LITERALS + extra[0]
            v.append(np.array([code[symbol], extra[1]], np.uint64))
            s.append(np.array([lengths[symbol], extra[2]]))
        values += v
        sizes += s
        starts.append(sum(map(len, v)))
    value, size = np.concatenate(values), np.concatenate(sizes)
    # every image starts at a byte of its own, with room for a whole word behind it
    first = np.concatenate([[0], np.cumsum(starts)])
    ends = np.cumsum(size)
    bits = np.diff(np.concatenate([[0], ends])[first])
    room = (bits + 31) // 32 + 1
    base = np.concatenate([[0], np.cumsum(room)])
    at = ends - size + np.repeat(32 * base[:-1] - np.concatenate([[0], np.cumsum(bits)])[:-1], starts)
    shifted = value << (at & 31).astype(np.uint64)
    word = at >> 5
    runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    packed = np.zeros(int(base[-1]) + 1, np.uint64)
    packed[word[runs]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), runs)
    packed[word[runs] + 1] += np.add.reduceat(shifted >> np.uint64(32), runs)
    raw = packed.astype("<u4").tobytes()
    return [raw[4 * int(w) : 4 * int(w) + (int(n) + 7) // 8] for w, n in zip(base[:-1], bits, strict=True)]


# --- reading grey images ------------------------------------------------------------------------

#: Images that advance together.
TOGETHER = 1024


def _undo_left(residual: np.ndarray, width: int) -> np.ndarray:
    """Green samples from their differences to the left (in the first column: to the sample above)."""
    rows = residual.reshape(-1, width).copy()
    rows[:, 0] = np.cumsum(rows[:, 0], dtype=np.uint8)
    return np.cumsum(rows, 1, dtype=np.uint8).ravel()


def read_grey(files: Sequence[bytes]) -> list[np.ndarray]:
    """Samples of each entry of ``files`` (one or more grey images end to end, or one file of stacked images).

    Images in which only green is coded, without cache and entropy image, are read together: with subtract-green, then perhaps
    the left predictor, or with a palette of greys; any other goes through ``decode_stream`` and must have equal red, green and blue.
    """
    streams = [(i, s) for i, f in enumerate(files) for s in chunks(f)]
    planes: list[np.ndarray | None] = [None] * len(streams)
    simple = []
    for k, (_, data) in enumerate(streams):
        stream = Bits(data)
        width, height, transforms, coded = _start(stream)
        kinds = [t[0] for t in transforms]
        undo = None
        if kinds == [SUBTRACT_GREEN, PREDICTOR] and ((transforms[1][1] >> 8 & 0xFF) == LEFT).all():
            undo = functools.partial(_undo_left, width=width)
        elif kinds == [PALETTE] and ((c := _channels(transforms[0][1])) == c[:, 1:2])[:, :3].all():
            undo = functools.partial(_undo_greys, colours=transforms[0][1], width=width, coded=coded)
        if undo is not None or kinds == [SUBTRACT_GREEN]:
            head = _read_head(stream, coded, height, True)
            group = head.groups[0]
            fixed = [p.only for p in group[1:]]
            if head.entropy is None and not head.cache_bits and fixed[:2] == [0, 0] and fixed[2] == (0 if PREDICTOR in kinds else 255) and fixed[3] is not None and fixed[3] < 4 and group[0].bits <= LONGEST:
                simple.append((coded * height, k, stream.at, group[0], _distance(fixed[3] + 1, coded), undo))
                continue
        pixels = decode_stream(data)
        if not ((pixels[..., 0] == pixels[..., 1]) & (pixels[..., 2] == pixels[..., 1])).all():
            raise WebPError("the image is not grey")
        planes[k] = pixels[..., 1].ravel()
    simple.sort(key=lambda s: (s[0], s[1]))
    for at in range(0, len(simple), TOGETHER):
        group = simple[at : at + TOGETHER]
        for (_, k, *_, undo), plane in zip(group, _read_together([streams[s[1]][1] for s in group], group), strict=True):
            planes[k] = plane if undo is None else undo(plane)
    out: list[list[np.ndarray]] = [[] for _ in files]
    for (i, _), plane in zip(streams, planes, strict=True):
        out[i].append(plane)
    return [np.concatenate(p) if len(p) > 1 else p[0] if p else np.zeros(0, np.uint8) for p in out]


def _undo_greys(plane: np.ndarray, colours: np.ndarray, width: int, coded: int) -> np.ndarray:
    return (undo_palette(plane.astype(np.uint32).reshape(-1, coded) << 8, colours, width) >> 8 & 0xFF).astype(np.uint8).ravel()


def _read_together(streams: list[bytes], images: list[tuple]) -> list[np.ndarray]:
    sizes = np.array([s[0] for s in images], np.int64)
    base = np.concatenate([[0], np.cumsum([len(s) + 8 for s in streams])])
    raw = np.frombuffer(b"".join(s + bytes(8) for s in streams), np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    table = np.concatenate([lookup(s[3].lengths, LONGEST) for s in images])
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(start[-1]), np.uint8)
    live = np.arange(len(images))
    bit, place, row, stop = 8 * base[:-1] + np.array([s[2] for s in images]), start[:-1].copy(), np.arange(len(images)) << LONGEST, start[1:].copy()
    limit = 8 * (base[1:] - 8)
    nearest = int((stop - place).min()) if len(images) else 0
    while len(live):
        entry = table[row + (window[bit >> 3] >> (bit & 7) & ((1 << LONGEST) - 1))]
        bit += entry & 15
        symbol = entry >> 4
        if symbol.max() < LITERALS:
            out[place] = symbol
            place += 1
            nearest -= 1
            if nearest > 0:
                continue
        else:
            literal = symbol < LITERALS
            out[place[literal]] = symbol[literal]
            place[literal] += 1
            for j in np.flatnonzero(~literal).tolist():
                stream = Bits(streams[live[j]], int(bit[j] - 8 * base[live[j]]))
                length = _extended(int(symbol[j]) - LITERALS, stream)
                distance, p = images[live[j]][4], int(place[j])
                if distance > p - start[live[j]] or p + length > stop[j]:
                    raise WebPError("a back-reference leaves the image")
                out[p : p + length] = np.resize(out[p - distance : p], length)
                bit[j], place[j] = stream.at + 8 * base[live[j]], p + length
        if (bit > limit[live]).any():
            raise WebPError("the stream ends too early")
        going = place < stop
        if not going.all():
            live, bit, place, row, stop = live[going], bit[going], place[going], row[going], stop[going]
        nearest = int((stop - place).min()) if len(live) else 0
    return [out[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
