import numpy as np
import pytest

from lumenframe.functions import kernels
from lumenframe.operators import pixels


def traced(mask):
    """Border length of one connected mask, cell by cell."""
    cells = {tuple(c) for c in np.argwhere(mask)}
    if len(cells) < 2:
        return 0.0
    steps = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    start = min(cells)
    path, at, came = [], start, 0
    while True:
        way = next(w % 8 for w in range(came + 1, came + 9) if (at[0] + steps[w % 8][0], at[1] + steps[w % 8][1]) in cells)
        if path and at == start and way == path[0]:
            return sum(2**0.5 if w % 2 else 1.0 for w in path)
        path.append(way)
        at, came = (at[0] + steps[way][0], at[1] + steps[way][1]), (way + 4) % 8


@pytest.mark.parametrize("share", [0.2, 0.4, 0.6, 0.95])
def test_all_labels_at_once_equal_one_at_a_time(share):
    draw = np.random.default_rng(int(share * 100))
    for _ in range(6):
        labels = kernels.label_components(draw.random((29, 37)) < share)
        y, x = np.nonzero(labels)
        order = draw.permutation(len(y))
        ids, area, length = kernels.perimeters(labels[y, x][order], y[order], x[order])
        assert list(ids) == list(range(1, labels.max() + 1)) and list(area) == list(np.bincount(labels.ravel())[1:])
        assert length == pytest.approx([traced(labels == i) for i in ids])


def test_known_shapes_and_none():
    y, x = np.nonzero(np.ones((3, 3)))
    assert kernels.perimeters(np.full(9, 7), y, x)[2] == [8]
    assert kernels.perimeters(np.array([4]), np.array([9]), np.array([0]))[2] == [0]
    assert kernels.perimeters(np.array([4, 4, 4]), np.array([0, 5, 5]), np.array([0, 5, 6]))[2] == [0]  # the first part is a lone cell
    assert not len(kernels.perimeters(*[np.empty(0, np.int64)] * 3)[0])


def test_parts_of_an_image_agree(spark):
    labels = kernels.label_components(np.random.default_rng(3).random((40, 40)) < 0.3)
    rows = [(i, int(y), int(x), int(labels[y, x])) for i in (None, 1) for y, x in np.argwhere(labels >= 0)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, label int")
    whole, split = (sorted(map(tuple, pixels.object_shapes(px, ["image_id"], parts=p).collect()), key=str) for p in (1, 3))
    assert whole == split and len(whole) == 2 * labels.max()
    assert pixels.object_shapes(px.where("label < 0"), ["image_id"]).count() == 0


@pytest.mark.parametrize("shape,radius", [((1, 1), 3), ((5, 40), 4), ((33, 31), 7), ((20, 20), 0), ((6, 9), 25)])
def test_opening_by_chords_equals_every_offset_of_the_disc(shape, radius):
    image = np.random.default_rng(radius).integers(0, 256, shape).astype(np.uint8)

    def naive(a, how, outside):
        wide = np.pad(a, radius, constant_values=outside)
        inside = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]
        return how.reduce([wide[radius + y : radius + y + shape[0], radius + x : radius + x + shape[1]] for y, x in inside])

    opened = naive(naive(image, np.minimum, 255), np.maximum, 0)
    assert (kernels.top_hat(image, radius) == image - np.minimum(opened, image)).all()
