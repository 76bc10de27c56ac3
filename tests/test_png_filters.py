import time

import numpy as np
import pytest

from lumenframe.sources.images import unfilter_rows


def filtered(image, filters):
    """Row filters of PNG, byte by byte."""
    height, width, step = image.shape
    at = lambda y, x, c: int(image[y, x, c]) if y >= 0 and x >= 0 else 0
    out = np.zeros_like(image)
    for y, x, c in np.ndindex(*image.shape):
        a, b, d = at(y, x - 1, c), at(y - 1, x, c), at(y - 1, x - 1, c)
        nearest = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
        out[y, x, c] = (int(image[y, x, c]) - [0, a, b, (a + b) // 2, nearest][filters[y]]) % 256
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 9, 2), (9, 1, 3), (13, 7, 4), (6, 21, 6)])
@pytest.mark.parametrize("kinds", [(0, 1, 2), (3,), (4,), (0, 1, 2, 3, 4)])
def test_undoes_every_filter(shape, kinds):
    draw = np.random.default_rng(sum(shape))
    image = draw.integers(0, 256, shape).astype(np.uint8)
    filters = draw.choice(kinds, shape[0]).astype(np.uint8)
    assert (unfilter_rows(filters, filtered(image, filters)) == image).all()


def test_unknown_filters_and_large_images():
    with pytest.raises(ValueError):
        unfilter_rows(np.array([5], np.uint8), np.zeros((1, 1, 1), np.uint8))
    began = time.perf_counter()
    assert unfilter_rows(np.full(1024, 4, np.uint8), np.ones((1024, 1024, 2), np.uint8)).shape == (1024, 1024, 2)
    assert time.perf_counter() - began < 20  # two million bytes
