"""JPEG kernels: entropy decoding of sequential and progressive scans, transforms of all blocks at once, colour.

Coefficients are kept per component as (rows of blocks, blocks, 64) in zigzag order.  Every bit position of a scan has
its next 16 bits in a table, so that a Huffman code is one lookup whatever its length.  8-bit grey, YCbCr and RGB
images with sampling factors of 1 and 2 are decoded; arithmetic coding, 12 bits and four components are errors.
The inverse transform is in doubles, so values may differ by one from decoders that use integers.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np

#: Zigzag order: diagonals of an 8 x 8 block, in turns up and down; position -> 8 * row + column.
ZIGZAG = np.array([8 * y + x for y, x in sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_U = np.arange(8)
#: BASIS[u, x]: the u-th cosine at x, orthonormal.
BASIS = np.where(_U[:, None] == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)
SEQUENTIAL, PROGRESSIVE = (0xC0, 0xC1), (0xC2,)
#: JFIF's conversion of luma and chroma to red, green and blue.
TO_RGB = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])


@dataclass
class Component:
    ident: int
    across: int
    down: int
    table: int
    width: int = 0  # blocks that hold pixels
    height: int = 0
    stride: int = 0  # blocks kept, whole units
    coefficients: array = field(default_factory=lambda: array("i"))


@dataclass
class Frame:
    height: int
    width: int
    progressive: bool
    components: list[Component]
    quantizers: dict[int, np.ndarray]
    ycc: bool


def lookup(lengths: bytes, symbols: bytes) -> array:
    """Canonical code of so many symbols of each length: for all next 16 bits, 256 * length + symbol, or -1."""
    out, code, at = np.full(1 << 16, -1, np.int32), 0, 0
    for length, many in enumerate(lengths, 1):
        for symbol in symbols[at : at + many]:
            span = 1 << 16 - length
            if (code + 1) * span > 1 << 16:
                raise ValueError("a JPEG code has too many symbols")
            out[code * span : (code + 1) * span] = length << 8 | symbol
            code += 1
        at += many
        code <<= 1
    return array("i", out.tobytes())


def windows(segment: bytes) -> memoryview:
    """The 16 bits from each bit position on; zeros follow the end."""
    b = np.frombuffer(segment.replace(b"\xff\x00", b"\xff") + bytes(10), np.uint8).astype(np.uint32)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return memoryview((three[:, None] >> (8 - np.arange(8, dtype=np.uint32)) & 0xFFFF).astype(np.uint16).ravel())


class Scan:
    """One pass over coefficients ``first`` to ``last``, from bit ``low`` on, refining if ``high`` is set."""

    def __init__(self, first: int, last: int, high: int, low: int) -> None:
        self.first, self.last, self.high, self.low = first, last, high, low

    def start(self, segment: bytes) -> None:
        self.bits, self.at, self.run, self.before = windows(segment), 0, 0, {}

    def symbol(self, codes: array) -> int:
        entry = codes[self.bits[self.at]]
        if entry < 0:
            raise ValueError("no such JPEG code")
        self.at += entry >> 8
        return entry & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.bits[self.at] >> 16 - n
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> n - 1 else value - (1 << n) + 1

    def block(self, c: Component, at: int, dc: array, ac: array) -> None:
        if self.first == 0:
            if self.high:
                c.coefficients[at] |= self.take(1) << self.low
            else:
                self.before[c.ident] = value = self.before.get(c.ident, 0) + self.signed(self.symbol(dc))
                c.coefficients[at] = value << self.low
        if self.last:
            (self.refine if self.high else self.fill)(c.coefficients, at, ac)

    def fill(self, out: array, at: int, ac: array) -> None:
        if self.run:
            self.run -= 1
            return
        k = max(1, self.first)
        while k <= self.last:
            zeros, size = divmod(self.symbol(ac), 16)
            if size:
                k += zeros
                if k > self.last:
                    raise ValueError("a JPEG run leaves its block")
                out[at + k] = self.signed(size) * (1 << self.low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                self.run = (1 << zeros) + self.take(zeros) - 1
                return

    def refine(self, out: array, at: int, ac: array) -> None:
        """One more bit of coefficients known, and new ones of that size; ``left`` counts zeros to pass."""
        bit, k = 1 << self.low, self.first
        while k <= self.last and not self.run:
            left, size = divmod(self.symbol(ac), 16)
            new = 0
            if size:
                new = bit if self.take(1) else -bit
            elif left < 15:
                self.run = (1 << left) + self.take(left)
                break
            while k <= self.last:
                known = out[at + k]
                if known:
                    self.sharpen(out, at + k, bit)
                elif left == 0:
                    out[at + k] = new
                    k += 1
                    break
                else:
                    left -= 1
                k += 1
        if self.run:
            for place in range(at + k, at + self.last + 1):
                if out[place]:
                    self.sharpen(out, place, bit)
            self.run -= 1

    def sharpen(self, out: array, place: int, bit: int) -> None:
        if self.take(1):
            out[place] += bit if out[place] > 0 else -bit


def _segments(raw: bytes) -> list[tuple[int, bytes, bytes]]:
    """(marker, contents, entropy-coded bytes behind it) of each segment."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG header")
    out, at = [], 2
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        kind = raw[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        coded = b""
        if kind == 0xDA:
            # Coded bytes end at a marker that is neither a stuffed byte nor a restart.
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(raw, at)
            stop = end.start() if end else len(raw)
            coded, at = raw[at:stop], stop
        out.append((kind, body, coded))
    return out


def coefficients(raw: bytes) -> Frame:
    """All scans of a file decoded into its frame's components."""
    quantizers: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], array] = {}
    frame, interval, adobe = None, 0, None
    for kind, body, coded in _segments(raw):
        if kind == 0xDB:
            while body:
                wide, ident = divmod(body[0], 16)
                size = 128 if wide else 64
                quantizers[ident], body = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64), body[1 + size :]
        elif kind == 0xC4:
            while body:
                many = sum(body[1:17])
                codes[divmod(body[0], 16)], body = lookup(body[1:17], body[17 : 17 + many]), body[17 + many :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind in (*SEQUENTIAL, *PROGRESSIVE):
            frame = _frame(kind, body, quantizers)
        elif kind in range(0xC3, 0xD0) and kind != 0xC8:
            raise ValueError(f"JPEG of kind {kind - 0xC0} is not supported")
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a JPEG scan without a frame")
            _scan(frame, body, coded, codes, interval)
    if frame is None:
        raise ValueError("no JPEG frame")
    names = bytes(c.ident for c in frame.components)
    frame.ycc = len(names) == 3 and (adobe != 0 if adobe is not None else names != b"RGB")
    return frame


def _frame(kind: int, body: bytes, quantizers: dict[int, np.ndarray]) -> Frame:
    bits, height, width, n = struct.unpack(">BHHB", body[:6])
    if bits != 8 or n not in (1, 3) or not height or not width:
        raise ValueError("only 8-bit JPEG of 1 or 3 components is supported")
    parts = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
    if n == 1:
        parts[0].across = parts[0].down = 1
    if any(x not in (1, 2) for c in parts for x in (c.across, c.down)):
        raise ValueError("only JPEG sampling factors of 1 and 2 are supported")
    most_x, most_y = max(c.across for c in parts), max(c.down for c in parts)
    for c in parts:
        c.width, c.height = -(-width * c.across // (8 * most_x)), -(-height * c.down // (8 * most_y))
        c.stride = -(-width // (8 * most_x)) * c.across
        c.coefficients = array("i", bytes(4 * 64 * c.stride * -(-height // (8 * most_y)) * c.down))
    return Frame(height, width, kind in PROGRESSIVE, parts, quantizers, False)


def _scan(frame: Frame, body: bytes, coded: bytes, codes: dict[tuple[int, int], array], interval: int) -> None:
    n = body[0]
    chosen = [(next(c for c in frame.components if c.ident == body[k]), body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * n, 2)]
    first, last, bits = body[1 + 2 * n : 4 + 2 * n]
    scan = Scan(first, last, *divmod(bits, 16))
    none = array("i", [-1]) * (1 << 16)
    plan = [(c, codes.get((0, d), none), codes.get((1, a), none)) for c, d, a in chosen]
    if n == 1:
        c, dc, ac = plan[0]
        units = [[(c, 64 * (y * c.stride + x), dc, ac)] for y in range(c.height) for x in range(c.width)]
    else:
        c = frame.components[0]
        wide, high = c.stride // c.across, len(c.coefficients) // (64 * c.stride * c.down)
        inner = [(c, dc, ac, y, x) for c, dc, ac in plan for y in range(c.down) for x in range(c.across)]
        units = ([(c, 64 * ((v * c.down + y) * c.stride + u * c.across + x), dc, ac) for c, dc, ac, y, x in inner] for v in range(high) for u in range(wide))
    segments = iter(re.split(rb"\xff[\xd0-\xd7]", coded) if interval else [coded])
    for k, unit in enumerate(units):
        if k % (interval or 1 << 62) == 0:
            scan.start(next(segments))
        for block in unit:
            scan.block(*block)


def planes(frame: Frame) -> list[np.ndarray]:
    """Samples of each component, dequantised and transformed, whole blocks."""
    out = []
    for c in frame.components:
        x = np.zeros((len(c.coefficients) // 64, 64))
        x[:, ZIGZAG] = np.frombuffer(c.coefficients, np.int32).reshape(-1, 64) * frame.quantizers[c.table]
        pixels = BASIS.T @ x.reshape(-1, 8, 8) @ BASIS
        pixels = pixels.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.stride)
        out.append(np.clip(np.floor(pixels + 128.5), 0, 255).astype(np.int32))
    return out


def doubled(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis: each three parts of its own and one of the neighbour's, ends repeated."""
    x = np.moveaxis(plane, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.stack([3 * x + before, 3 * x + after], axis=1).reshape(-1, *x.shape[1:])
    return np.moveaxis(out, 0, axis)


def decode_jpeg(raw: bytes) -> np.ndarray:
    """Height x width, or x 3 (red, green, blue), in 8 bits."""
    frame = coefficients(raw)
    most_x, most_y = max(c.across for c in frame.components), max(c.down for c in frame.components)
    full = []
    for c, plane in zip(frame.components, planes(frame)):
        plane = plane[: -(-frame.height * c.down // most_y), : -(-frame.width * c.across // most_x)]
        scale = 1
        for axis, factor in ((0, most_y // c.down), (1, most_x // c.across)):
            if factor == 2:
                plane, scale = doubled(plane, axis), 4 * scale
        full.append(((plane + scale // 2) // scale)[: frame.height, : frame.width])
    if len(full) == 1:
        return full[0].astype(np.uint8)
    rgb = np.stack(full, axis=-1).astype(np.float64)
    if frame.ycc:
        rgb = (rgb - [0, 128, 128]) @ TO_RGB.T
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


class Writer:
    """Bits of a scan with stuffed bytes."""

    def __init__(self) -> None:
        self.text: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.text.append(format(value & (1 << n) - 1, f"0{n}b"))

    def signed(self, value: int, n: int) -> None:
        self.put(value if value > 0 else value - 1, n)

    def bytes(self) -> bytes:
        bits = "".join(self.text)
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, 2 + len(body)) + body


#: A code in which every symbol below 255 has eight bits: its own value.
FLAT = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))


def encode_jpeg(blocks: list[np.ndarray], quantizers: list[np.ndarray], height: int, width: int, sampling: list[tuple[int, int]] | None = None) -> bytes:
    """A sequential file of quantised coefficients: per component (rows of blocks, blocks, 64) in zigzag order, whole units."""
    sampling = sampling or [(1, 1)] * len(blocks)
    out = b"\xff\xd8" + b"".join(marker(0xDB, bytes([k]) + bytes(q.astype(np.uint8))) for k, q in enumerate(quantizers))
    parts = b"".join(bytes([k + 1, a << 4 | d, min(k, len(quantizers) - 1)]) for k, (a, d) in enumerate(sampling))
    out += marker(0xC0, struct.pack(">BHHB", 8, height, width, len(blocks)) + parts)
    out += marker(0xC4, b"\x00" + FLAT) + marker(0xC4, b"\x10" + FLAT)
    out += marker(0xDA, bytes([len(blocks)]) + b"".join(bytes([k + 1, 0]) for k in range(len(blocks))) + bytes([0, 63, 0]))
    bits, before = Writer(), [0] * len(blocks)
    for v in range(blocks[0].shape[0] // sampling[0][1]):
        for u in range(blocks[0].shape[1] // sampling[0][0]):
            for k, (a, d) in enumerate(sampling):
                for y, x in np.ndindex(d, a):
                    before[k] = _put_block(bits, blocks[k][v * d + y, u * a + x].tolist(), before[k])
    return out + bits.bytes() + b"\xff\xd9"


def _put_block(bits: Writer, values: list[int], before: int) -> int:
    size = abs(values[0] - before).bit_length()
    bits.put(size, 8)
    bits.signed(values[0] - before, size)
    zeros = 0
    for k, value in enumerate(values[1:], 1):
        if not value:
            zeros += 1
            continue
        while zeros > 15:
            bits.put(0xF0, 8)
            zeros -= 16
        size = abs(value).bit_length()
        bits.put(zeros << 4 | size, 8)
        bits.signed(value, size)
        zeros = 0
    if zeros:
        bits.put(0, 8)
    return values[0]
