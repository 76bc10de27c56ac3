"""TIFF kernels over range reads: directories (classic and 64-bit), strips and tiles, deflate, LZW and PackBits.

``read(offset, size)`` is all that is known of a file, so a page costs its directory and its own chunks, and of a page
any band of chunk rows is read alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

Read = Callable[[int, int], bytes]
#: Formats of the field types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags.
WIDTH, HEIGHT, BITS, PACKING, DESCRIPTION, OFFSETS, PLANES, STRIP_ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORM = 317, 322, 323, 324, 325, 339
#: Packings.
PLAIN, LZW, DEFLATE, PACKBITS = (1,), (5,), (8, 32946), (32773,)
CLEAR, END = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out, bits, held, table, before = [], 0, 0, [], b""
    width, at = 9, 0
    while True:
        while held < width:
            if at >= len(data):
                return b"".join(out)
            bits, held, at = bits << 8 | data[at], held + 8, at + 1
        held -= width
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("no such LZW code")
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))


def unpack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


@dataclass(frozen=True)
class Page:
    """One image of a file: its type, and the grid of chunks (strips are chunks as wide as the image)."""

    height: int
    width: int
    planes: int
    kind: str
    packing: int
    predictor: int
    chunk: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.kind).newbyteorder("=")

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk[1])

    def bands(self, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of chunk rows of about ``limit`` bytes of pixels, one at least."""
        rows = -(-self.height // self.chunk[0])
        step = max(1, limit // max(1, self.chunk[0] * self.width * self.planes * self.dtype.itemsize))
        return ((k, min(rows, k + step)) for k in range(0, rows, step))

    def pixels(self, read: Read, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Rows of the chunk rows ``first`` to ``stop``: height x width, or x planes."""
        high, wide = self.chunk
        stop = -(-self.height // high) if stop is None else stop
        rows = min(self.height, stop * high) - first * high
        out = np.empty((rows, self.width, self.planes), self.dtype)
        for k in range(first * self.across, stop * self.across):
            y, x = (k // self.across - first) * high, k % self.across * wide
            part = self._chunk(read(self.offsets[k], self.counts[k]), min(high, rows - y) if wide == self.width else high)
            out[y : y + high, x : x + wide] = part[: rows - y, : self.width - x]
        return out[..., 0] if self.planes == 1 else out

    def _chunk(self, data: bytes, high: int) -> np.ndarray:
        if self.packing in DEFLATE:
            data = zlib.decompress(data)
        elif self.packing in LZW:
            data = unpack_lzw(data)
        elif self.packing in PACKBITS:
            data = unpack_bits(data)
        wide = self.chunk[1]
        values = np.frombuffer(data, self.kind, high * wide * self.planes).reshape(high, wide, self.planes).astype(self.dtype)
        return np.cumsum(values, axis=1, dtype=self.dtype) if self.predictor == 2 else values


def pages(read: Read) -> tuple[list[Page], str]:
    """The pages of a file, and the description of the first that has one."""
    head = read(0, 16)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(end + "H", head[2:4])[0] if end and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    many, place, entry = (("H", "I", 12), ("Q", "Q", 20))[magic - 42]
    wide = struct.calcsize(place)
    at = struct.unpack(end + place, head[4:8] if magic == 42 else head[8:16])[0]
    out, description, seen = [], "", set()
    while at:
        if at in seen:
            raise ValueError("TIFF directories form a ring")
        seen.add(at)
        size = struct.calcsize(many)
        count = struct.unpack(end + many, read(at, size))[0]
        body = read(at + size, entry * count + wide)
        tags: dict[int, tuple] = {}
        for k in range(count):
            field = body[entry * k : entry * (k + 1)]
            tag, kind, n = struct.unpack(end + "HH" + place, field[: 4 + wide])
            if kind not in TYPES:
                continue
            form = f"{end}{n}s" if kind == 2 else end + TYPES[kind] * n
            bytes_ = struct.calcsize(form)
            where = field[4 + wide : 4 + wide + bytes_] if bytes_ <= wide else read(struct.unpack(end + place, field[4 + wide :])[0], bytes_)
            tags[tag] = struct.unpack(form, where)
        out.append(_page(tags, end))
        description = description or tags.get(DESCRIPTION, (b"",))[0].rstrip(b"\0").decode("utf-8", "replace")
        at = struct.unpack(end + place, body[entry * count :])[0]
    return out, description


def _page(tags: dict[int, tuple], end: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    height, width, planes, bits, packing = tags[HEIGHT][0], tags[WIDTH][0], one(PLANES, 1), one(BITS, 1), one(PACKING, 1)
    if packing not in (*PLAIN, *LZW, *DEFLATE, *PACKBITS) or bits % 8 or (planes > 1 and one(PLANAR, 1) != 1) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only plain, deflate, LZW or PackBits TIFF of whole bytes in chunky order is supported")
    kind = f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORM, 1)]}{bits // 8}"
    if TILE_OFFSETS in tags:
        return Page(height, width, planes, kind, packing, one(PREDICTOR, 1), (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]), tags[TILE_OFFSETS], tags[TILE_COUNTS])
    return Page(height, width, planes, kind, packing, one(PREDICTOR, 1), (min(height, one(STRIP_ROWS, height)), width), tags[OFFSETS], tags[COUNTS])
