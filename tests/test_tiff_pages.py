"""TIFF packings and layouts against hand-packed files, and the page source: tasks, pushed filters, bytes, streams."""

import struct
import zlib

import numpy as np
import pytest

from lumenframe.functions import tiff
from lumenframe.sources import images, pages


def packed_lzw(data):
    table, out, held, count, width = {bytes([k]): k for k in range(256)}, 0, b"", 258, 9
    bits = []

    def put(code):
        bits.append(format(code, f"0{width}b"))

    put(256)
    for k in range(len(data)):
        byte = data[k : k + 1]
        if held + byte in table:
            held += byte
            continue
        put(table[held])
        table[held + byte], count = count, count + 1
        width = 9 + (count >= 512) + (count >= 1024) + (count >= 2048)  # the reader is one entry behind
        if count == 4094:
            put(256)
            table, count, width = {bytes([k]): k for k in range(256)}, 258, 9
        held = byte
    if held:
        put(table[held])
        width = 9 + (count + 1 >= 512) + (count + 1 >= 1024) + (count + 1 >= 2048)
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def packed_bits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        out += bytes([257 - run, data[at]]) if run > 1 else bytes([0, data[at]])
        at += run
    return out + b"\x80"


PACKERS = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: packed_bits}


def tiff_file(image, packing=1, end="<", big=False, tile=None, rows=None, predictor=1):
    """One page, written chunk by chunk."""
    height, width = image.shape[:2]
    planes = 1 if image.ndim == 2 else image.shape[2]
    high, wide = tile or (rows or height, width)
    x = image.reshape(height, width, planes)
    chunks = []
    for y in range(0, height, high):
        for c in range(0, width, wide):
            part = x[y : y + high, c : c + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            chunks.append(PACKERS[packing](part.astype(part.dtype.newbyteorder(end)).tobytes()))
    word, entry = ("Q", "HHQ") if big else ("I", "HHI")
    out = bytearray(struct.pack(end + "2sHHHQ", b"II" if end == "<" else b"MM", 43, 8, 0, 0) if big else struct.pack(end + "2sHI", b"II" if end == "<" else b"MM", 42, 0))
    places = []
    for chunk in chunks:
        places.append(len(out))
        out += chunk
    lists = []
    for values in (places, list(map(len, chunks))):
        lists.append(len(out))
        out += struct.pack(f"{end}{len(values)}{word}", *values)
    kind = 16 if big else 4
    several = lambda k, values: lists[k] if len(values) > 1 else values[0]
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 4, 1, 8 * image.dtype.itemsize), (259, 4, 1, packing), (277, 4, 1, planes), (317, 4, 1, predictor), (339, 4, 1, form)]
    if tile:
        tags += [(322, 4, 1, wide), (323, 4, 1, high), (324, kind, len(chunks), several(0, places)), (325, kind, len(chunks), several(1, list(map(len, chunks))))]
    else:
        tags += [(273, kind, len(chunks), several(0, places)), (278, 4, 1, high), (279, kind, len(chunks), several(1, list(map(len, chunks))))]
    at = len(out)
    out += struct.pack(end + ("Q" if big else "H"), len(tags))
    for tag, k, n, value in sorted(tags):
        field = struct.pack(end + ("I" if k == 4 else word), value)
        out += struct.pack(end + entry, tag, k, n) + field.ljust(8 if big else 4, b"\0")
    out += bytes(8 if big else 4)
    struct.pack_into(end + word, out, 8 if big else 4, at)
    return bytes(out)


@pytest.mark.parametrize("packing", list(PACKERS))
@pytest.mark.parametrize("layout", [{}, {"rows": 7}, {"tile": (16, 32)}, {"tile": (16, 32), "predictor": 2}, {"rows": 5, "predictor": 2, "end": ">"}, {"big": True, "tile": (48, 16), "end": ">"}, {"big": True}])
def test_every_packing_and_layout(packing, layout):
    rng = np.random.default_rng(packing)
    for image in (rng.integers(0, 9, (45, 70)).astype(np.uint16), rng.integers(0, 255, (33, 40, 3)).astype(np.uint8), (np.arange(2000).reshape(40, 50) // 7 - 90).astype(np.int32)):
        raw = tiff_file(image, packing, **layout)
        found, _ = tiff.pages(images.reading(raw))
        assert len(found) == 1 and (found[0].pixels(images.reading(raw)) == image).all()
        bands = [found[0].pixels(images.reading(raw), *band) for band in found[0].bands(2000)]
        assert (np.concatenate(bands) == image).all()


def test_long_lzw_and_faults():
    data = np.random.default_rng(1).integers(0, 4, 60_000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(packed_lzw(data)) == data and tiff.unpack_lzw(packed_lzw(b"")) == b"" and tiff.unpack_lzw(packed_lzw(b"a" * 5000)) == b"a" * 5000
    codes = "".join(format(c, "09b") for c in (256, 0, 1, 257)).ljust(40, "0")  # clear, 0, 1, end by hand
    golden = int(codes, 2).to_bytes(5, "big")
    assert tiff.unpack_lzw(golden) == b"\x00\x01" and tiff.unpack_bits(b"\x02abc\xfeZ\x80") == b"abcZZZ"
    for bad in (b"", b"II*\0", b"MM\0\x2b\0\x08\0\0", b"PNG"):
        with pytest.raises((ValueError, struct.error)):
            tiff.pages(images.reading(bad))
    ring = bytearray(tiff_file(np.zeros((2, 2), np.uint8)))
    at = struct.unpack("<I", ring[4:8])[0]
    struct.pack_into("<I", ring, len(ring) - 4, at)
    with pytest.raises(ValueError, match="ring"):
        tiff.pages(images.reading(bytes(ring)))


def stack_of(n, size=16):
    return (np.arange(n)[:, None, None] + np.zeros((1, size, size))).astype(np.uint16)


def test_pages_are_dealt_to_tasks_and_filters_reach_them(spark, tmp_path):
    folder = tmp_path / "stacks"
    folder.mkdir()
    (folder / "long.tif").write_bytes(images.encode_tiff(stack_of(1000)))
    (folder / "short.tiff").write_bytes(tiff_file(stack_of(1)[0], 5, tile=(16, 16)))
    (folder / "bad.tif").write_bytes(b"II*\0nothing")
    (folder / "note.txt").write_text("x")
    reader = lambda **o: pages.register(spark).read.format("tiff_pages").options(**o).load(str(folder))
    df = reader(partition_bytes=65_536)
    assert df.rdd.getNumPartitions() >= 8
    rows = {(r["path"].rsplit("/", 1)[1], r["page"]): r for r in df.collect()}
    assert len(rows) == 1002 and rows["bad.tif", None]["error"] and rows["short.tiff", 0]["shape"] == [16, 16]
    assert all(np.frombuffer(rows["long.tif", k]["data"], np.uint16)[0] == k for k in range(1000))
    some = df.where("page BETWEEN 700 AND 702 AND path LIKE '%long%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "long" in plan and "700" not in plan  # the source took the range of pages over, Spark filters the path alone
    read = some.select("page", "bytes_read").collect()
    assert sorted(r["page"] for r in read) == [700, 701, 702] and sum(r["bytes_read"] for r in read) == 3 * 512
    assert some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert df.where("page IN (3, 5)").count() == 2 and df.where("page = 0").count() == 2 and df.where("page IS NULL").count() == 1
    # Bands of a page: rows of strips.
    (folder / "tall.tif").write_bytes(tiff_file(np.arange(64 * 8).reshape(64, 8).astype(np.uint16), 8, rows=4))
    bands = reader(band_bytes=128).where("path LIKE '%tall%'").orderBy("first_row").collect()
    assert [r["first_row"] for r in bands] == list(range(0, 64, 8)) and b"".join(r["data"] for r in bands) == np.arange(512).astype(np.uint16).tobytes()


def test_stream_goes_on_behind_its_checkpoint(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def drain():
        stream = pages.register(spark).readStream.format("tiff_pages").load(str(folder)).select("path", "page", "data", "error")
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination(120)

    (folder / "a.tif").write_bytes(images.encode_tiff(stack_of(3)))
    drain()
    assert spark.read.parquet(out).count() == 3
    (folder / "b.tif").write_bytes(images.encode_tiff(stack_of(2)))
    (folder / "c.tif").write_bytes(b"none")
    drain()
    drain()
    want = spark.read.format("tiff_pages").load(str(folder)).select("path", "page", "data", "error")
    got = spark.read.parquet(out)
    assert got.count() == 6 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
