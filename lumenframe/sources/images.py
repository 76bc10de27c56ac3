"""Image sources: folders of files through Spark's binaryFile reader, decoded in tasks without outside libraries.

PNG (8 and 16 bit, not interlaced), JPEG (sequential and progressive), BMP (8 and 24 bit) and TIFF (plain, deflate, LZW
or PackBits, strips or tiles, classic or 64-bit, any number of pages, integers and floats) are decoded here; another
format is an error of its row.  Stacks too large for a task are read by ``pages``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import tiff
from lumenframe.functions.jpeg import decode_jpeg
from lumenframe.sources.pages import located

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
IMAGE_SCHEMA = "path string, height int, width int, channels int, dtype string, axes string, shape array<int>, data binary, error string"


def find_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime and content of all image files below a folder, any case of the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$"))


def unfilter_rows(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of a PNG: (rows), (rows, pixels, bytes of a pixel) -> bytes.

    A pixel needs those to its left, above and between, so the pixels of one anti-diagonal are undone together.  In an
    image with a margin of one, an anti-diagonal is a slice of a fixed stride.  Images without Average and Paeth go by rows.
    """
    if filters.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    height, width, step = rows.shape
    if filters.max(initial=0) < 3:
        out = rows.copy()
        for y, how in enumerate(filters):
            if how == 1:
                out[y] = np.cumsum(out[y], axis=0, dtype=np.uint8)
            elif how == 2 and y:
                out[y] += out[y - 1]
        return out
    wide = np.zeros((height + 1, width + 1, step), np.uint8)
    wide[1:, 1:] = rows
    flat = wide.reshape(-1, step)
    kinds = filters.astype(np.int16)[:, None]
    for d in range(height + width - 1):
        top, end = max(0, d - width + 1), min(height - 1, d)
        first = (top + 1) * (width + 1) + d - top + 1
        spots = [slice(first - k, first - k + (end - top) * width + 1, width) for k in (0, 1, width + 1, width + 2)]
        left, above, corner = (flat[x].astype(np.int16) for x in spots[1:])
        how = kinds[top : end + 1]
        p, q, both = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        paeth = np.where((p <= q) & (p <= both), left, np.where(q <= both, above, corner))
        flat[spots[0]] += np.select([how == 1, how == 2, how == 3, how == 4], [left, above, (left + above) >> 1, paeth], 0).astype(np.uint8)
    return wide[1:, 1:]


def decode_png(raw: bytes) -> np.ndarray:
    at, body, width = 8, b"", 0
    palette = None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if interlaced or depth not in (8, 16):
                raise ValueError("only 8- and 16-bit PNG without interlacing is supported")
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += data
        at += 12 + size
    if not width:
        raise ValueError("no PNG header")
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = planes * depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = unfilter_rows(lines[:, 0], lines[:, 1:].reshape(height, width, step)).reshape(height, width * step)
    pixels = out.reshape(height, width, planes) if depth == 8 else out.view(">u2").astype(np.uint16).reshape(height, width, planes)
    if palette is not None and color == 3:
        return palette[pixels[..., 0]]
    return pixels[..., 0] if planes == 1 else pixels


def encode_png(image: np.ndarray) -> bytes:
    """8- or 16-bit grey or colour image."""
    planes = 1 if image.ndim == 2 else image.shape[2]
    depth = 8 * image.dtype.itemsize
    rows = image.astype(f">u{depth // 8}").reshape(image.shape[0], -1).view(np.uint8).reshape(image.shape[0], -1)
    body = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, {1: 0, 3: 2, 4: 6}[planes], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def decode_bmp(raw: bytes) -> np.ndarray:
    begin, head, width, height, _, bits = struct.unpack("<I I i i H H", raw[10:30])
    if bits not in (8, 24):
        raise ValueError("only 8- and 24-bit BMP is supported")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(height), begin).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows.reshape(abs(height), width, 3)[..., ::-1].copy()
    table = np.frombuffer(raw, np.uint8, 1024, 14 + head).reshape(256, 4)[:, 2::-1]
    color = table[rows]
    return color[..., 0] if (color == color[..., :1]).all() else color


@dataclass
class TiffPages:
    pages: list[np.ndarray]
    description: str


def reading(raw: bytes) -> tiff.Read:
    return lambda offset, size: raw[offset : offset + size]


def decode_tiff(raw: bytes) -> TiffPages:
    found, description = tiff.pages(reading(raw))
    return TiffPages([page.pixels(reading(raw)) for page in found], description)


def encode_tiff(pages: np.ndarray, description: str = "") -> bytes:
    """Uncompressed little-endian TIFF of a stack of pages."""
    text = description.encode() + b"\0"
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    form = {"u": 1, "i": 2, "f": 3}[pages.dtype.kind]
    for k, page in enumerate(pages):
        body = page.astype(page.dtype.newbyteorder("<")).tobytes()
        where = len(out)
        out += body + b"\0" * (len(body) % 2)
        note = len(out)
        if k == 0:
            out += text + b"\0" * (len(text) % 2)
        h, w = page.shape[:2]
        planes = 1 if page.ndim == 2 else page.shape[2]
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 1), (262, 3, 1, 1 if planes == 1 else 2)]
        if k == 0 and len(text) > 4:
            tags.append((270, 2, len(text), note))
        tags += [(273, 4, 1, where), (277, 3, 1, planes), (278, 4, 1, h), (279, 4, 1, len(body)), (339, 3, 1, form)]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def collapse_stack(stack: np.ndarray) -> np.ndarray:
    """Largest value over leading axes until an image, or an image with 3 or 4 channels, is left."""
    while stack.ndim > 2 and not (stack.ndim == 3 and stack.shape[-1] in (3, 4)):
        stack = stack.max(axis=0)
    return stack


def decode(path: str, raw: bytes) -> np.ndarray:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "png":
        return decode_png(raw)
    if kind == "bmp":
        return decode_bmp(raw)
    if kind in ("jpg", "jpeg"):
        return decode_jpeg(raw)
    if kind in ("tif", "tiff"):
        return collapse_stack(np.stack(decode_tiff(raw).pages))
    raise ValueError(f"unsupported image format: {kind}")


def load_images(files: DataFrame) -> DataFrame:
    """Decode (path, content): one row per file, with its error if it can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):  # one image at a time bounds the memory
                try:
                    x = decode(path, bytes(raw))
                    row = (path, x.shape[0], x.shape[1], 1 if x.ndim == 2 else x.shape[2], str(x.dtype), "YX" if x.ndim == 2 else "YXC", list(x.shape), x.tobytes(), None)
                except Exception as e:
                    row = (path, 0, 0, 0, None, None, [], None, str(e))
                yield pd.DataFrame([row], columns=[c.split()[0] for c in IMAGE_SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, IMAGE_SCHEMA)


STACK_AXES = "TZCYX"
SERIES_SCHEMA = "path string, series int, axes string, shape array<int>, t int, z int, c int, dtype string, data binary, error string"


@dataclass(frozen=True)
class ImageStack:
    """Axes and shape of a stack; its pixels are rows of :func:`load_series`."""

    path: str
    axes: str
    shape: tuple[int, ...]
    dtype: str

    @property
    def has_channel(self) -> bool:
        return "C" in self.axes

    @property
    def has_z(self) -> bool:
        return "Z" in self.axes

    @property
    def has_time(self) -> bool:
        return "T" in self.axes


def series_of(found: list[tiff.Page], description: str) -> list[tuple[str, tuple[int, ...], list[int]]]:
    """(axes, shape, pages in the order T, Z, C) of each series: of the OME images, or else all pages of one size."""
    height, width = found[0].height, found[0].width
    if "<OME" not in description and "<Pixels" not in description:
        n = len(found)
        return [("YX", (height, width), [0])] if n == 1 else [("ZYX", (n, height, width), list(range(n)))]
    out, at = [], 0
    root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", description))
    for pixels in (e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "Pixels"):
        sizes = {a: int(pixels.get(f"Size{a}", 1)) for a in STACK_AXES}
        # DimensionOrder names the fastest axis first; pages are put into the order T, Z, C.
        fast = [a for a in pixels.get("DimensionOrder", "XYCZT") if a in "TZC"]
        number = np.arange(at, at + sizes["T"] * sizes["Z"] * sizes["C"]).reshape([sizes[a] for a in reversed(fast)])
        pages = number.transpose([list(reversed(fast)).index(a) for a in "TZC"]).ravel().tolist()
        at += len(pages)
        if at > len(found):
            raise ValueError(f"OME sizes need {at} pages, the file has {len(found)}")
        axes = "".join(a for a in STACK_AXES if a in "YX" or sizes[a] > 1)
        out.append((axes, tuple(sizes[a] for a in axes), pages))
    if at != len(found):
        raise ValueError(f"OME sizes need {at} pages, the file has {len(found)}")
    return out


def load_series(files: DataFrame, series_index: int = 0) -> DataFrame:
    """One row per page of a TIFF file's series, axes taken from the file (T, Z, C, Y, X as there are), or its error."""
    if series_index < 0:
        raise ValueError("series_index must not be negative")
    names = [c.split()[0] for c in SERIES_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    read = reading(bytes(raw))
                    every, description = tiff.pages(read)
                    found = series_of(every, description)
                    if series_index >= len(found):
                        raise IndexError(f"series {series_index} of {len(found)}")
                    axes, shape, pages = found[series_index]
                    sizes = dict(zip(axes, shape))
                    for k, page in enumerate(pages):
                        t, z, c = np.unravel_index(k, [sizes.get(a, 1) for a in "TZC"])
                        x = every[page].pixels(read)
                        yield pd.DataFrame([(path, series_index, axes, list(shape), int(t), int(z), int(c), str(x.dtype), x.tobytes(), None)], columns=names)
                except Exception as e:
                    yield pd.DataFrame([(path, series_index, None, None, None, None, None, None, None, str(e))], columns=names)

    return files.select("path", "content").mapInPandas(run, SERIES_SCHEMA)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) as files below a folder of any store that Arrow opens; (path, size) of those written.

    Names are unique, so a task that is run again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = located(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            names, contents = batch.column("name").to_pylist(), batch.column("content").to_pylist()
            for name, content in zip(names, contents):
                with system.open_output_stream(f"{inner}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{n}" for n in names], "size": [len(c) for c in contents]})

    return files.select("name", "content").mapInArrow(run, "path string, size long")


def make_cells_image(n_cells: int = 200, size: int = 512, background: int = 60, noise: float = 4.0, seed: int = 0) -> np.ndarray:
    """An 8-bit test image: bright discs of radius 4 to 8 at random places on a noisy background."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    image = np.full((size, size), float(background))
    for cy, cx, r, level in zip(*(rng.integers(lo, hi, n_cells) for lo, hi in ((10, size - 10), (10, size - 10), (4, 9), (120, 180)))):
        image[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = background + level
    return np.clip(image + rng.normal(0, noise, image.shape), 0, 255).astype(np.uint8)


STACK_SCHEMA = "path string, page int, shape array<int>, dtype string, data binary, error string"


def load_stacks(files: DataFrame, axes: str) -> DataFrame:
    """TIFF files as stacks with declared axes (leading axes fill up with pages), one row per page, or a file's error."""
    names = [c.split()[0] for c in STACK_SCHEMA.split(", ")]
    unknown = set(axes) - set(STACK_AXES)
    if unknown or len(set(axes)) != len(axes):
        raise ValueError(f"unknown or repeated axes: {axes}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, k, list(page.shape), str(page.dtype), page.tobytes(), None) for k, page in enumerate(decode_tiff(bytes(raw)).pages)]
                except Exception as e:
                    rows = [(path, None, None, None, None, str(e))]
                for row in rows:
                    yield pd.DataFrame([row], columns=names)

    return files.select("path", "content").mapInPandas(run, STACK_SCHEMA)


OME_SCHEMA = (
    "path string, size_x int, size_y int, size_z int, size_c int, size_t int, physical_x double, physical_y double, physical_z double, "
    "unit_x string, unit_y string, unit_z string, n_pages int, dtype string, axes string, shape array<int>, channel_names array<string>, error string"
)


def ome_info(description: str) -> dict[str, object]:
    """Sizes, physical sizes with units and channel names of OME-XML; what is missing is None."""
    root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", description))
    pixels = next((e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "Pixels"), None)
    if pixels is None:
        raise ValueError("no Pixels element")
    real = lambda name: float(pixels.get(name)) if pixels.get(name) else None
    names = [e.get("Name") or e.get("ID") or "" for e in pixels.iter() if e.tag.rsplit("}", 1)[-1] == "Channel"]
    out: dict[str, object] = {f"size_{a.lower()}": int(pixels.get(f"Size{a}", 1)) for a in "XYZCT"}
    out |= {f"physical_{a.lower()}": real(f"PhysicalSize{a}") for a in "XYZ"}
    return out | {f"unit_{a.lower()}": pixels.get(f"PhysicalSize{a}Unit") for a in "XYZ"} | {"channel_names": names}


def _axes(found: list[tiff.Page], description: str) -> dict[str, object]:
    """Axes and shape of the first series, unknown where the sizes told don't fit the pages."""
    try:
        axes, shape, _ = series_of(found, description)[0]
    except ValueError:
        return {}
    return {"axes": axes, "shape": list(shape)}


def read_ome_info(files: DataFrame) -> DataFrame:
    """One row per file: its OME metadata, or the error of a file that has none."""
    names = [c.split()[0] for c in OME_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                row: dict[str, object] = {"path": path}
                try:
                    found, description = tiff.pages(reading(bytes(raw)))  # directories alone
                    row |= {"n_pages": len(found), "dtype": str(found[0].dtype)}
                    row |= ome_info(description)
                    row |= _axes(found, description)
                except Exception as e:
                    row["error"] = str(e)
                yield pd.DataFrame([[row.get(n) for n in names]], columns=names)

    return files.select("path", "content").mapInPandas(run, OME_SCHEMA)
