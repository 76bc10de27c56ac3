"""JPEG kernels against hand-made coefficients, in sequential and progressive scans."""

import numpy as np
import pytest

from lumenframe.functions import jpeg
from lumenframe.sources import images


def blocks(rng, rows, columns, dense=0.3, top=40):
    x = rng.integers(-top, top + 1, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < dense)
    x[..., 0] = rng.integers(-90, 90, (rows, columns))
    x[0, 0, 1:] = 0
    return x


def pixels(coefficients, quantizer):
    """The transform by its formula, value by value."""
    out = np.zeros((8 * coefficients.shape[0], 8 * coefficients.shape[1]))
    for by, bx in np.ndindex(*coefficients.shape[:2]):
        f = np.zeros((8, 8))
        for k, place in enumerate(jpeg.ZIGZAG):
            f[place // 8, place % 8] = coefficients[by, bx, k] * quantizer[k]
        for y, x in np.ndindex(8, 8):
            s = sum(
                (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                for v, u in np.argwhere(f)
            )
            out[8 * by + y, 8 * bx + x] = s / 4
    return np.clip(np.floor(out + 128.5), 0, 255)


def held(raw):
    return [np.frombuffer(c.coefficients, np.int32).reshape(-1, c.stride, 64) for c in jpeg.coefficients(raw).components]


def scan(parts, first, last, high, low, bits):
    return jpeg.marker(0xDA, bytes([len(parts)]) + b"".join(bytes([p, 0]) for p in parts) + bytes([first, last, high << 4 | low])) + bits.bytes()


def shrunk(value, low):
    return int(np.sign(value)) * (abs(int(value)) >> low)


def progressive(x, quantizer, height, width):
    """A grey image in seven scans: bits of the mean, then two bands, each sharpened bit by bit; runs of ended blocks."""
    out = b"\xff\xd8" + jpeg.marker(0xDB, bytes([0]) + bytes(quantizer.astype(np.uint8)))
    out += jpeg.marker(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    out += jpeg.marker(0xC4, b"\x00" + jpeg.FLAT) + jpeg.marker(0xC4, b"\x10" + jpeg.FLAT)
    flat = x.reshape(-1, 64)
    bits, before = jpeg.Writer(), 0
    for b in flat:
        value = int(b[0]) >> 1
        size = abs(value - before).bit_length()
        bits.put(size, 8)
        bits.signed(value - before, size)
        before = value
    out += scan([1], 0, 0, 0, 1, bits)
    for first, last in ((1, 5), (6, 63)):
        for low, refining in ((2, False), (1, True), (0, True)):
            bits, ended, waiting = jpeg.Writer(), 0, []

            def close():
                nonlocal ended, waiting
                if ended:
                    n = ended.bit_length() - 1
                    bits.put(n << 4, 8)
                    bits.put(ended - (1 << n), n)
                    for bit in waiting:
                        bits.put(bit, 1)
                ended, waiting = 0, []

            for b in flat:
                band = [(k, shrunk(b[k], low), shrunk(b[k], low + 1) if refining else 0) for k in range(first, last + 1)]
                new = [k for k, value, old in band if value and not old]
                stop = max(new, default=first - 1)
                zeros, passed = 0, []
                if new:
                    close()
                for k, value, old in band:
                    if k > stop:
                        if old:
                            waiting.append(abs(value) & 1)
                        continue
                    if old:
                        passed.append(abs(value) & 1)
                    elif not value:
                        zeros += 1
                        if zeros == 16 and refining:  # the sixteenth zero goes with the symbol
                            bits.put(0xF0, 8)
                            for bit in passed:
                                bits.put(bit, 1)
                            zeros, passed = 0, []
                    else:
                        while zeros > 15:
                            bits.put(0xF0, 8)
                            zeros -= 16
                        size = 1 if refining else abs(value).bit_length()
                        bits.put(zeros << 4 | size, 8)
                        bits.put(int(value > 0), 1) if refining else bits.signed(value, size)
                        for bit in passed:
                            bits.put(bit, 1)
                        zeros, passed = 0, []
                if stop < last:
                    ended += 1
            close()
            out += scan([1], first, last, low + 1 if refining else 0, low, bits)
    bits = jpeg.Writer()
    for b in flat:
        bits.put(int(b[0]) & 1, 1)
    return out + scan([1], 0, 0, 1, 0, bits) + b"\xff\xd9"


def test_grey_blocks_by_the_formula():
    rng = np.random.default_rng(0)
    q = rng.integers(1, 12, 64)
    x = blocks(rng, 2, 3)
    raw = jpeg.encode_jpeg([x], [q], 13, 21)
    assert (held(raw)[0] == x).all()
    assert (jpeg.decode_jpeg(raw) == pixels(x, q)[:13, :21]).all()


@pytest.mark.parametrize("dense", [0.02, 0.3, 0.9])
def test_progressive_scans_give_the_same_coefficients(dense):
    rng = np.random.default_rng(3)
    q = np.full(64, 3)
    x = blocks(rng, 3, 4, dense)
    raw = progressive(x, q, 24, 32)
    assert (held(raw)[0] == x).all()
    assert (jpeg.decode_jpeg(raw) == jpeg.decode_jpeg(jpeg.encode_jpeg([x], [q], 24, 32))).all()


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (1, 2), (2, 2)])
def test_colour_and_sampling(sampling):
    rng = np.random.default_rng(4)
    a, d = sampling
    parts = [blocks(rng, 2 * d, 3 * a, 0.1, 9), blocks(rng, 2, 3, 0.1, 9), blocks(rng, 2, 3, 0.1, 9)]
    q = [np.full(64, 2), np.full(64, 3)]
    height, width = 16 * d - 3, 24 * a - 5
    raw = jpeg.encode_jpeg(parts, q, height, width, [sampling, (1, 1), (1, 1)])
    assert all((x == y).all() for x, y in zip(held(raw), parts))
    y, cb, cr = pixels(parts[0], q[0])[:height, :width], *(pixels(p, q[1])[: -(-height // d), : -(-width // a)] for p in parts[1:])

    def spread(plane):
        """Each sample's value at its place between neighbours, three parts to one, ends repeated."""
        out, scale = np.zeros((height, width)), (4 if a == 2 else 1) * (4 if d == 2 else 1)
        at = lambda i, factor, top: [(i, 4)] if factor == 1 else [(i // 2, 3), (min(max(i // 2 + (1 if i % 2 else -1), 0), top), 1)]
        for i, j in np.ndindex(height, width):
            s = sum(wi * wj * plane[k, m] for k, wi in at(i, d, len(plane) - 1) for m, wj in at(j, a, plane.shape[1] - 1)) / ((4 if d == 1 else 1) * (4 if a == 1 else 1))
            out[i, j] = (s + scale // 2) // scale
        return out

    cb, cr = spread(cb) - 128, spread(cr) - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    assert (jpeg.decode_jpeg(raw) == np.clip(np.floor(want + 0.5), 0, 255)).all()


def test_restarts_and_faults():
    rng = np.random.default_rng(5)
    x, q = blocks(rng, 1, 6), np.full(64, 2)
    whole = jpeg.encode_jpeg([x], [q], 8, 48)
    body = [jpeg.encode_jpeg([x[:, k : k + 2]], [q], 8, 16) for k in (0, 2, 4)]
    start = whole.index(b"\xff\xda") + 10
    cut = [b[b.index(b"\xff\xda") + 10 : -2] for b in body]
    raw = whole[:2] + jpeg.marker(0xDD, b"\x00\x02") + whole[2:start] + cut[0] + b"\xff\xd0" + cut[1] + b"\xff\xd1" + cut[2] + b"\xff\xd9"
    assert (held(raw)[0] == x).all()
    for bad in (b"", b"\xff\xd8\xff\xd9", whole[: start + 2], whole.replace(b"\xff\xc0", b"\xff\xc9"), whole[:1] + whole):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode_jpeg(bad)


def test_files_decode_or_tell_why(spark):
    rng = np.random.default_rng(6)
    x, q = blocks(rng, 1, 2), np.full(64, 4)
    raw = jpeg.encode_jpeg([x], [q], 7, 9)
    df = spark.createDataFrame([("a.JPG", raw), ("b.jpeg", raw[:-9][:40]), ("c.jpg", b"")], "path string, content binary")
    out = {r["path"]: r for r in images.load_images(df).collect()}
    assert (np.frombuffer(out["a.JPG"]["data"], np.uint8).reshape(7, 9) == jpeg.decode_jpeg(raw)).all() and out["a.JPG"]["error"] is None
    assert out["b.jpeg"]["error"] and out["c.jpg"]["error"] and out["c.jpg"]["data"] is None
