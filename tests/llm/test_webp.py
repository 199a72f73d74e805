"""The decoder against streams of a small writer that uses what the batch writer does not."""

import numpy as np
import pytest

from lattice.llm import webp


class Writer(webp._Writer):
    def code(self, lengths):
        """A prefix code in the long form, with every length written by itself."""
        lengths = np.asarray(lengths)
        webp._put_lengths(self, lengths)
        return webp.codes(lengths), lengths

    def bytes(self):
        return self.value.to_bytes(-(-self.size // 8) + 1, "little")


def flat_code(alphabet):
    """A complete code over all symbols of an alphabet of at least two."""
    low = alphabet.bit_length() - 1
    short = (1 << (low + 1)) - alphabet
    return [low] * short + [low + 1] * (alphabet - short) if alphabet > 1 << low else [low] * alphabet


def put_image(w, pixels, cache_bits=0, main=False, entropy=None, copies=()):
    """Pixels (argb) as literals, cache hits where possible, and the given copies {position: (length, distance code)}."""
    height, width = pixels.shape
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(int(entropy is not None), 1)
        if entropy is not None:
            w.put(0, 3)
            put_image(w, entropy.astype(np.uint32) << 8)
            groups = int(entropy.max()) + 1
    size = 280 + (1 << cache_bits if cache_bits else 0)
    codes = [[w.code(flat_code(n)) for n in (size, 256, 256, 256, 40)] for _ in range(groups)]

    def put(g, k, symbol):
        code, lengths = codes[g][k]
        w.put(int(code[symbol]), int(lengths[symbol]))

    cache, flat, i, copies = {}, pixels.ravel().tolist(), 0, dict(copies)
    slot = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(flat):
        g = int(entropy[(i // width) >> 2, (i % width) >> 2]) if entropy is not None else 0
        if i in copies:
            length, distance = copies[i]
            for value, k, base in ((length, 0, 256), (distance, 4, 0)):
                symbol, extra, n = webp._length_symbol(value)
                put(g, k, base + symbol)
                w.put(extra, n)
        elif cache_bits and cache.get(slot(flat[i])) == flat[i]:
            put(g, 0, 280 + slot(flat[i]))
            length = 1
        else:
            p, length = flat[i], 1
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                put(g, k, p >> shift & 255)
        for p in flat[i : i + length]:
            if cache_bits:
                cache[slot(p)] = p
        i += length


def start(width, height):
    w = Writer()
    for value, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def rgba(pixels):
    return np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255, pixels >> 24 & 255], -1).astype(np.uint8)


@pytest.fixture
def image():
    return np.random.default_rng(3).integers(0, 2**32, (11, 13), dtype=np.uint32)


def test_literals_cache_entropy_and_copies(image):
    image[4:6] = image[2:4]  # copied from two rows above
    image[7, :] = image[6, 0]
    image[6, :] = image[6, 0]
    entropy = np.array([[0, 1, 0, 2], [1, 1, 2, 0], [2, 0, 0, 1]])
    for cache_bits in (0, 6):
        w = start(13, 11)
        w.put(0, 1)
        # distance code 5 is two rows up; code 2 the pixel before
        put_image(w, image, cache_bits, True, entropy, {4 * 13: (26, 5), 6 * 13 + 1: (25, 2)})
        assert (webp.decode_stream(w.bytes()) == rgba(image)).all()


def test_far_distance(image):
    image[8, :5] = image[0, :5]
    w = start(13, 11)
    w.put(0, 1)
    put_image(w, image, main=True, copies={8 * 13: (5, 8 * 13 + 120)})
    assert (webp.decode_stream(w.bytes()) == rgba(image)).all()


@pytest.mark.parametrize("n", [2, 3, 13, 40])
def test_palette(n):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 2**32, n, dtype=np.uint32)
    index = rng.integers(0, n, (5, 11))
    w = start(11, 5)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(n - 1, 8)
    channels = webp._channels(colours[None])[0].astype(np.int64)
    put_image(w, webp._packed(np.diff(channels, axis=0, prepend=0) & 255)[None])
    packing = webp.palette_packing(n)
    each = 8 >> packing
    width = -(-11 >> packing)
    packed = np.zeros((5, width), np.uint32)
    for x in range(11):
        packed[:, x >> packing] |= (index[:, x] << each * (x & ((1 << packing) - 1))).astype(np.uint32) << 8
    w.put(0, 1)
    put_image(w, packed, main=True)
    assert (webp.decode_stream(w.bytes()) == rgba(colours[index])).all()


def plain_prediction(mode, p, x, y):
    """Prediction of one pixel from the finished ones, channel by channel."""
    at = lambda a, b: p[b][a]
    if x == 0 and y == 0:
        return (0, 0, 0, 255)
    if y == 0:
        return at(x - 1, 0)
    if x == 0:
        return at(0, y - 1)
    left, top, corner = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1)
    right = at(x + 1, y - 1) if x + 1 < len(p[0]) else at(0, y)
    avg = lambda a, b: tuple((i + j) // 2 for i, j in zip(a, b))
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, corner)]
        return left if sum(abs(g - a) for g, a in zip(guess, left)) < sum(abs(g - a) for g, a in zip(guess, top)) else top
    if mode == 12:
        return tuple(clip(a + b - c) for a, b, c in zip(left, top, corner))
    if mode == 13:
        return tuple(clip(a + int((a - c) / 2)) for a, c in zip(avg(left, top), corner))
    return {0: (0, 0, 0, 255), 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top), 9: avg(top, right), 10: avg(avg(left, corner), avg(top, right))}[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode, image):
    pixels = [[tuple(map(int, c)) for c in row] for row in webp._channels(image)]
    residual = np.array([[[(a - b) & 255 for a, b in zip(pixels[y][x], plain_prediction(mode, pixels, x, y))] for x in range(13)] for y in range(11)])
    w = start(13, 11)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(0, 3)
    put_image(w, np.full((3, 4), mode << 8, np.uint32))
    w.put(0, 1)
    put_image(w, webp._packed(residual), main=True)
    assert (webp.decode_stream(w.bytes()) == rgba(image)).all()


def test_cross_colour_and_subtract_green(image):
    signed = lambda v: (v & 255) - 256 if (v & 255) > 127 else v & 255
    delta = lambda t, c: signed(t) * signed(c) >> 5
    to_red, to_blue, red_to_blue = 201, 37, 144
    coded = image.copy()
    for y in range(11):
        for x in range(13):
            a, r, g, b = (int(image[y, x]) >> s & 255 for s in (24, 16, 8, 0))
            r2, b2 = (r - delta(to_red, g)) & 255, (b - delta(to_blue, g) - delta(red_to_blue, r)) & 255
            coded[y, x] = a << 24 | (r2 - g & 255) << 16 | g << 8 | (b2 - g & 255)
    w = start(13, 11)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(0, 3)
    put_image(w, np.full((3, 4), 0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red, np.uint32))
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    put_image(w, coded, main=True)
    assert (webp.decode_stream(w.bytes()) == rgba(image)).all()


def test_grey_round_trip():
    rng = np.random.default_rng(5)
    images = [np.full(576, 255), np.zeros(1152), rng.integers(0, 256, 576 * 3), rng.integers(97, 122, 576 * 64), np.r_[rng.integers(0, 4, 570), [9] * 6], (rng.geometric(0.3, 5760) % 256)]
    images += [np.arange(576 * 9) // 3 % 251, rng.integers(0, 2, 576 * 7) * 77, rng.integers(0, 4, 576 * 5) + 250, rng.integers(30, 45, 576 * 4), np.cumsum(rng.integers(-1, 2, 576 * 64)) % 256]
    samples = np.concatenate(images).astype(np.uint8)
    edges = np.cumsum([0, *map(len, images)])
    streams = webp.write_grey(samples, edges, 576)
    files = [webp.file_of(s) for s in streams]
    kinds = set()
    for s, f, read, a, b in zip(streams, files, webp.read_grey(files), edges, edges[1:]):
        assert (read == samples[a:b]).all()
        (pixels,) = webp.decode(f)
        assert (pixels[..., 0].ravel() == samples[a:b]).all() and (pixels[..., 3] == 255).all()
        kinds.add(tuple(t[0] for t in webp._start(webp.Bits(s))[2]))
    assert kinds == {(webp.SUBTRACT_GREEN,), (webp.SUBTRACT_GREEN, webp.PREDICTOR), (webp.PALETTE,)}
    heights = (np.diff(edges) // 576).tolist()
    whole = webp.stacked(streams[3:5], 576, heights[3:5])
    assert (webp.read_grey([whole])[0] == samples[edges[3] : edges[5]]).all() and len(webp.decode(whole)) == 2
    # canvas of the stack: width, then height, each less one
    assert whole[12:16] == b"VP8X" and int.from_bytes(whole[24:27], "little") == 575 and int.from_bytes(whole[27:30], "little") == sum(heights[3:5]) - 1
    assert (webp.read_grey([files[0] + files[2]])[0] == np.r_[images[0], images[2]]).all()


def test_broken_files(image):
    w = start(13, 11)
    w.put(0, 1)
    put_image(w, image, main=True)
    good = webp.file_of(w.bytes())
    assert (webp.decode(good)[0] == rgba(image)).all()
    for bad in (good[:40], b"RIFF" + good[4:8] + b"WEBPVP8 " + good[16:], webp.file_of(b"\x00" + w.bytes()[1:]), webp.file_of(w.bytes()[:60])):
        with pytest.raises(webp.WebPError):
            webp.decode(bad)
