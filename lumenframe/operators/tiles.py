"""Segmentation of images larger than a task: halos, thresholds and labels over a grid of tiles.

A tile is a row: keys, ``tile`` (its place in the grid, one number an axis), ``shape`` and ``data`` (bytes, row by
row).  All tiles of an image have one size but those at its far edges.  Tiles are labelled alone; labels that touch
over a border are links of a graph whose components are found by Spark, so neither an image nor its objects meet in
one task.  Labels are numbered as the whole-image kernels do, in the order of an object's first cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe import scratch
from lumenframe.functions import kernels
from lumenframe.functions.columns import with_scalars

#: Bits of one coordinate in a cell's number, by the count of axes; cells are ordered as their numbers.
COORDINATE_BITS = {2: 31, 3: 21}
#: First coordinates that share a range in which objects are counted off.
RANGE_CELLS = 256
TILE_SCHEMA = "tile array<int>, shape array<int>, data binary"
#: Cells that smoothing, opening and closing reach over.
HALO = 5


def _keys(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def cut(image: np.ndarray, size: tuple[int, ...]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(tile, shape, data) of an image that fits a task."""
    for at in np.ndindex(*(-(-n // s) for n, s in zip(image.shape, size))):
        part = image[tuple(slice(i * s, (i + 1) * s) for i, s in zip(at, size))]
        yield list(at), list(part.shape), np.ascontiguousarray(part).tobytes()


def _each(columns: list[str], out: str, f: Callable[[dict], list[dict]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one row at a time, so that a task holds one tile; the schema comes from the first columns' types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [batch.schema.field(c) for c in columns]
            schema = pa.schema([*fields, *pa.schema(_ARROW[out])])
            for k in range(len(batch)):
                rows = f({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_ARROW = {
    "pieces": [("tile", _INTS), ("low", _INTS), ("shape", _INTS), ("data", pa.binary())],
    "counts": [("counts", _LONGS)],
    "tiles": [("tile", _INTS), ("shape", _INTS), ("data", pa.binary())],
    "local": [("tile", _INTS), ("shape", _INTS), ("data", pa.binary()), ("nodes", _LONGS), ("cells", _LONGS), ("owners", _LONGS)],
}


def with_halo(tiles: DataFrame, keys: list[str], size: tuple[int, ...], halo: int, dtype: str) -> DataFrame:
    """Tiles grown by up to ``halo`` cells of their neighbours: keys, tile, low (cells grown below), shape, data."""
    if halo > min(size):
        raise ValueError("a halo reaches no further than the neighbouring tiles")

    def pieces(row: dict) -> list[dict]:
        x = np.frombuffer(row["data"], dtype).reshape(row["shape"])
        out = []
        for way in np.ndindex(*[3] * x.ndim):
            way = np.array(way) - 1
            # What lies within the halo of the tile that way: its low side sees our high end, and the other way round.
            part = x[tuple(slice(0, halo) if w < 0 else slice(max(0, n - halo), n) if w > 0 else slice(None) for w, n in zip(way, x.shape))]
            to = np.array(row["tile"]) + way
            if (to >= 0).all():
                out.append({k: row[k] for k in keys} | {"tile": to.tolist(), "low": (-way).tolist(), "shape": list(part.shape), "data": part.tobytes()})
        return out

    kinds = _keys(tiles, keys)
    dealt = tiles.select(*keys, "tile", "shape", "data").mapInArrow(_each(keys, "pieces", pieces), f"{kinds}, tile array<int>, low array<int>, shape array<int>, data binary")

    def join(table: pa.Table) -> pa.Table:
        parts = {tuple(w): np.frombuffer(d, dtype).reshape(s) for w, s, d in zip(*(table.column(c).to_pylist() for c in ("low", "shape", "data")))}
        axes = table.column("low")[0].as_py()
        middle = (0,) * len(axes)
        if middle not in parts:  # beyond the grid
            return table.slice(0, 0)
        x = parts[middle]
        low, high = ([parts[tuple(s * (a == k) for a in range(x.ndim))].shape[k] if tuple(s * (a == k) for a in range(x.ndim)) in parts else 0 for k in range(x.ndim)] for s in (-1, 1))
        out = np.zeros([a + n + b for a, n, b in zip(low, x.shape, high)], dtype)
        for way, part in parts.items():
            at = tuple(slice(0, l) if w < 0 else slice(l + n, l + n + h) if w > 0 else slice(l, l + n) for w, l, n, h in zip(way, low, x.shape, high))
            out[at] = part
        row = {k: [table.column(k)[0].as_py()] for k in keys} | {"tile": [table.column("tile")[0].as_py()], "low": [low], "shape": [list(out.shape)], "data": [out.tobytes()]}
        return pa.Table.from_pydict(row, schema=table.schema)

    return dealt.groupBy(*keys, "tile").applyInArrow(join, f"{kinds}, tile array<int>, low array<int>, shape array<int>, data binary")


def _inner(x: np.ndarray, row: dict, size: tuple[int, ...]) -> np.ndarray:
    """A grown tile without its halo."""
    return x[tuple(slice(low, low + s) for low, s in zip(row["low"], size))]


def _stars(edges: DataFrame) -> DataFrame:
    """(u, root) of the nodes of links (u, v): each gets the least node it reaches, by hooking and halving of paths."""
    links = scratch.table(edges.where("u <> v").distinct(), "tile-links")
    parent = links.select("u").union(links.select("v")).distinct().select("u", F.col("u").alias("p"))
    parent = scratch.table(parent, "tile-parents")
    while True:
        one, other = parent.select(F.col("u"), F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        ends = links.join(one, "u").join(other, "v")
        # Roots hook to the least root linked to them or to a node of theirs.
        hooks = ends.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("h")).groupBy("u").agg(F.min("h").alias("h"))
        hooked = scratch.table(parent.join(hooks, "u", "left").select("u", F.least("p", "h").alias("p")), "tile-hooked")
        up = hooked.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        new = scratch.table(hooked.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "tile-parents")
        if new.join(parent.select("u", F.col("p").alias("old")), "u").where("p <> old").isEmpty():
            return new.select("u", F.col("p").alias("root"))
        parent = new


def label_tiles(masks: DataFrame, keys: list[str], size: tuple[int, ...], *, connectivity: int | None = None) -> DataFrame:
    """Tiles of masks (a byte a cell) to tiles of labels (32-bit, 0 outside objects): keys, tile, shape, data."""
    axes = len(size)
    bits = COORDINATE_BITS[axes]
    shifts = np.array([bits * (axes - 1 - a) for a in range(axes)])
    near = [o for o in kernels.structure(axes, connectivity or axes) if o > (0,) * axes]

    def local(row: dict) -> list[dict]:
        labels = kernels.label_components(np.frombuffer(row["data"], np.uint8).reshape(row["shape"]) > 0, connectivity)
        cells = np.argwhere(labels)
        owner = labels[tuple(cells.T)]
        place = ((cells + np.array(row["tile"]) * size) << shifts).sum(axis=1)
        first = np.unique(owner, return_index=True)[1]  # cells come in order, so a label's first is its least
        nodes = place[first]
        edge = ((cells == 0) | (cells == np.array(labels.shape) - 1)).any(axis=1)
        known = {k: row[k] for k in keys} | {"tile": row["tile"], "shape": row["shape"], "data": labels.astype("<i4").tobytes()}
        return [known | {"nodes": nodes.tolist(), "cells": place[edge].tolist(), "owners": nodes[owner[edge] - 1].tolist()}]

    kinds = _keys(masks, keys)
    found = masks.select(*keys, "tile", "shape", "data").mapInArrow(_each(keys, "local", local), f"{kinds}, {TILE_SCHEMA}, nodes array<long>, cells array<long>, owners array<long>")
    found = scratch.table(found, "local-labels")

    def node(column: str) -> Column:
        return F.struct(*keys, F.col(column).alias("node"))

    border = found.select(*keys, F.explode(F.arrays_zip("cells", "owners")).alias("b")).select(*keys, F.col("b.cells").alias("cell"), F.col("b.owners").alias("owner"))
    steps = F.array(*[F.lit(int(sum(s << int(k) for s, k in zip(o, shifts)))) for o in near])
    beside = border.select(*keys, "cell", F.col("owner").alias("other"), F.explode(steps).alias("step"))
    beside = beside.select(*keys, (F.col("cell") + F.col("step")).alias("cell"), "other")
    edges = border.join(beside, [*keys, "cell"]).where("owner <> other").select(node("owner").alias("u"), node("other").alias("v"))
    roots = _stars(edges).select(*[F.col(f"u.{k}").alias(k) for k in keys], F.col("u.node").alias("node"), F.col("root.node").alias("root"))
    objects = found.select(*keys, "tile", F.posexplode("nodes").alias("local", "node"))
    objects = scratch.table(objects.join(roots, [*keys, "node"], "left").select(*keys, "tile", "local", "node", F.coalesce("root", "node").alias("root")), "tile-objects")
    # Roots counted off in ranges of the first coordinate, so that no task orders all objects of an image.
    heads = objects.select(*keys, "root").distinct().withColumn("range", F.floor(F.shiftright("root", int(shifts[0])) / RANGE_CELLS))
    held = heads.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    held = held.select(*keys, "range", (F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("root"))
    heads = heads.withColumn("rank", rank).join(held, [*keys, "range"]).select(*keys, "root", (F.col("before") + F.col("rank")).cast("int").alias("label"))
    names = objects.join(heads, [*keys, "root"]).groupBy(*keys, "tile").agg(F.array_sort(F.collect_list(F.struct("local", "label"))).alias("names"))
    return _renamed(found.select(*keys, "tile", "shape", "data"), keys, names.select(*keys, "tile", F.col("names.label").alias("names")), kinds)


def _renamed(tiles: DataFrame, keys: list[str], names: DataFrame, kinds: str) -> DataFrame:
    """Labels replaced by ``names`` of their number, from 1 on."""

    def rename(row: dict) -> list[dict]:
        new = np.array([0, *(row["names"] or [])], "<i4")
        return [{k: row[k] for k in (*keys, "tile", "shape")} | {"data": new[np.frombuffer(row["data"], "<i4")].tobytes()}]

    return tiles.join(names, [*keys, "tile"], "left").mapInArrow(_each(keys, "tiles", rename), f"{kinds}, {TILE_SCHEMA}")


def segment_tiles(tiles: DataFrame, keys: list[str], size: tuple[int, int], *, min_area: int = 15, max_area_frac: float = 0.25) -> DataFrame:
    """Threshold segmentation of 8-bit grey images in tiles, as the whole-image kernel: smooth, threshold, open and close, label, filter.

    The threshold comes from the image's histogram of smoothed values, 256 numbers a tile added up.
    """
    kinds = _keys(tiles, keys)
    smooth = np.array([0.25, 0.5, 0.25])
    grown = scratch.table(with_halo(tiles, keys, size, HALO, "u1"), "grown-tiles")

    def worked(row: dict) -> np.ndarray:
        return np.floor(kernels.convolve(np.frombuffer(row["data"], np.uint8).reshape(row["shape"]), smooth) + 0.5)

    def count(row: dict) -> list[dict]:
        x = _inner(worked(row), row, size)
        return [{k: row[k] for k in keys} | {"counts": np.bincount(x.astype(np.int64).ravel(), minlength=256).tolist()}]

    counts = grown.mapInArrow(_each(keys, "counts", count), f"{kinds}, counts array<long>").select(*keys, F.posexplode("counts").alias("value", "n"))
    counts = counts.groupBy(*keys, "value").agg(F.sum("n").alias("n"))

    def decide(table: pa.Table) -> pa.Table:
        n = np.zeros(256, np.int64)
        n[table.column("value").to_numpy()] = table.column("n").to_numpy()
        values = np.arange(256)
        between = kernels.otsu_counts(n, values + 0.0)
        over = values > int(np.floor(between))
        if n[over].sum() > 0.5 * n.sum():
            over = ~over
        inside, outside = n[over].sum(), n[~over].sum()
        clear = inside and outside and abs((values * n)[over].sum() / inside - (values * n)[~over].sum() / outside) >= kernels.MIN_CONTRAST
        row = {k: [table.column(k)[0].as_py()] for k in keys} | {"chosen": [(over & bool(clear)).tolist()], "pixels": [int(n.sum())]}
        return pa.Table.from_pydict(row, schema=pa.schema([*(table.schema.field(k) for k in keys), ("chosen", pa.list_(pa.bool_())), ("pixels", pa.int64())]))

    chosen = scratch.table(counts.groupBy(*keys).applyInArrow(decide, f"{kinds}, chosen array<boolean>, pixels long"), "thresholds")
    square = kernels.structure(2, 2)

    def mask(row: dict) -> list[dict]:
        x = np.array(row["chosen"])[worked(row).astype(np.int64)]
        x = kernels.dilate(kernels.erode(x, square), square)
        x = kernels.erode(kernels.dilate(x, square), square)
        x = _inner(x, row, size)
        return [{k: row[k] for k in (*keys, "tile")} | {"shape": list(x.shape), "data": x.astype(np.uint8).tobytes()}]

    masks = with_scalars(grown, keys, chosen.select(*keys, "chosen")).mapInArrow(_each(keys, "tiles", mask), f"{kinds}, {TILE_SCHEMA}")
    labels = scratch.table(label_tiles(masks, keys, size), "tile-labels")

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                label, n = np.unique(np.frombuffer(batch.column("data")[k].as_py(), "<i4"), return_counts=True)
                same = {c: pa.array([batch.column(c)[k].as_py()] * len(label), batch.schema.field(c).type) for c in (*keys, "tile")}
                yield pa.RecordBatch.from_pydict(same | {"label": pa.array(label, pa.int32()), "n": pa.array(n, pa.int64())})

    parts = scratch.table(labels.mapInArrow(areas, f"{kinds}, tile array<int>, label int, n long").where("label > 0"), "tile-areas")
    area = parts.groupBy(*keys, "label").agg(F.sum("n").alias("area"))
    area = with_scalars(area, keys, chosen.select(*keys, "pixels"))
    kept = area.where((F.col("area") >= min_area) & (F.col("area") <= F.col("pixels") * max_area_frac)).select(*keys, "label")
    kept = kept.withColumn("range", F.floor(F.col("label") / RANGE_CELLS))
    held = kept.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    held = held.select(*keys, "range", (F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("label"))
    kept = kept.withColumn("rank", rank).join(held, [*keys, "range"]).select(*keys, "label", (F.col("before") + F.col("rank")).cast("int").alias("new"))
    new = parts.join(kept, [*keys, "label"], "left").groupBy(*keys, "tile").agg(F.map_from_entries(F.collect_list(F.struct("label", F.coalesce("new", F.lit(0)).alias("new")))).alias("names"))

    def filtered(row: dict) -> list[dict]:
        x = np.frombuffer(row["data"], "<i4")
        names = dict(row["names"] or [])
        old, at = np.unique(x, return_inverse=True)
        out = np.array([names.get(int(label), 0) for label in old], "<i4")[at]
        return [{k: row[k] for k in (*keys, "tile", "shape")} | {"data": out.tobytes()}]

    return labels.join(new, [*keys, "tile"], "left").mapInArrow(_each(keys, "tiles", filtered), f"{kinds}, {TILE_SCHEMA}")


def tile_cells(tiles: DataFrame, keys: list[str], size: tuple[int, ...]) -> DataFrame:
    """Cells of objects in long form: keys, y, x (z first of three axes), label."""
    names = ["z", "y", "x"][-len(size) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x = np.frombuffer(batch.column("data")[k].as_py(), "<i4").reshape(batch.column("shape")[k].as_py())
                cells = np.argwhere(x)
                same = {c: pa.array([batch.column(c)[k].as_py()] * len(cells), batch.schema.field(c).type) for c in keys}
                at = cells + np.array(batch.column("tile")[k].as_py()) * size
                yield pa.RecordBatch.from_pydict(same | {n: pa.array(at[:, a], pa.int32()) for a, n in enumerate(names)} | {"label": pa.array(x[tuple(cells.T)], pa.int32())})

    return tiles.mapInArrow(run, f"{_keys(tiles, keys)}, {', '.join(f'{n} int' for n in names)}, label int")
