"""Tiles against the whole-image kernels."""

import numpy as np
import pytest

from lumenframe.functions import kernels
from lumenframe.operators import tiles
from lumenframe.sources import images


def rows(named, size):
    return [(name, *tile) for name, image in named.items() for tile in tiles.cut(image, size)]


def whole(df, size, shapes):
    out = {name: np.zeros(shape, np.int32) for name, shape in shapes.items()}
    for r in df.collect():
        at = tuple(slice(t * s, t * s + n) for t, s, n in zip(r["tile"], size, r["shape"]))
        out[r["image"]][at] = np.frombuffer(r["data"], "<i4").reshape(r["shape"])
    return out


def snake(n):
    """One winding object through all tiles, and its broken twin."""
    x = np.zeros((n, n), np.uint8)
    x[::4] = 1
    for k in range(0, n - 4, 4):
        x[k : k + 4, -1 if k % 8 == 0 else 0] = 1
    y = x.copy()
    y[n // 2, ::9] = 0
    return x, y


@pytest.mark.parametrize("connectivity", [1, 2])
def test_labels_of_tiles_equal_those_of_images(spark, connectivity):
    rng = np.random.default_rng(0)
    x, y = snake(45)
    named = {"noise": (rng.random((61, 50)) < 0.5).astype(np.uint8), "thin": (rng.random((30, 70)) < 0.3).astype(np.uint8), "snake": x, "broken": y, "empty": np.zeros((20, 20), np.uint8), "full": np.ones((33, 17), np.uint8)}
    size = (16, 12)
    df = spark.createDataFrame(rows(named, size), f"image string, {tiles.TILE_SCHEMA}").repartition(5)
    got = whole(tiles.label_tiles(df, ["image"], size, connectivity=connectivity), size, {n: m.shape for n, m in named.items()})
    for name, mask in named.items():
        assert (got[name] == kernels.label_components(mask, connectivity)).all(), name


def test_volumes_in_tiles(spark):
    rng = np.random.default_rng(1)
    named = {"v": (rng.random((11, 13, 17)) < 0.3).astype(np.uint8), "w": (rng.random((6, 20, 9)) < 0.15).astype(np.uint8)}
    size = (4, 5, 6)
    df = spark.createDataFrame(rows(named, size), f"image string, {tiles.TILE_SCHEMA}")
    for connectivity in (1, 3):
        got = whole(tiles.label_tiles(df, ["image"], size, connectivity=connectivity), size, {n: m.shape for n, m in named.items()})
        assert all((got[n] == kernels.label_components(m, connectivity)).all() for n, m in named.items())


def test_segmentation_in_tiles_equals_the_kernel(spark):
    cells = images.make_cells_image(60, 300, seed=3)
    rng = np.random.default_rng(2)
    named = {"cells": cells, "dark": 255 - cells, "flat": np.full((70, 90), 40, np.uint8), "noise": rng.integers(0, 255, (90, 140)).astype(np.uint8), "small": cells[:20, :33]}
    size = (64, 48)
    df = spark.createDataFrame(rows(named, size), f"image string, {tiles.TILE_SCHEMA}").repartition(4)
    done = tiles.segment_tiles(df, ["image"], size, max_area_frac=0.1)
    got = whole(done, size, {n: m.shape for n, m in named.items()})
    for name, image in named.items():
        assert (got[name] == kernels.segment_gray(image, max_area_frac=0.1)).all(), name
    assert got["cells"].max() > 20
    cells_long = tiles.tile_cells(done, ["image"], size).where("image = 'cells'").collect()
    assert {(r["y"], r["x"], r["label"]) for r in cells_long} == {(y, x, got["cells"][y, x]) for y, x in np.argwhere(got["cells"])}
    with pytest.raises(ValueError):
        tiles.with_halo(df, ["image"], (3, 3), 5, "u1")
