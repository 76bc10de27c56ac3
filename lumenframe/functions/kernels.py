"""NumPy kernels for what is no relational computation: neighbourhoods, labelling, assignment, digests of many messages."""

from __future__ import annotations

import math

import numpy as np

#: Fixed value: nothing is accepted below this contrast between foreground and background.
MIN_CONTRAST = 8.0


def convolve(image: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Separable convolution with a symmetric 1-D kernel along every axis; ``mode`` pads as np.pad does."""
    out, half = image.astype(np.float64), len(kernel) // 2
    for axis in range(image.ndim):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in range(image.ndim)], mode=mode if out.shape[axis] > half else "edge")
        n = out.shape[axis]
        out = sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))
    return out


def gaussian(image: np.ndarray, sigma: float, mode: str = "reflect") -> np.ndarray:
    half = max(1, int(round(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return convolve(image, k / k.sum(), mode)


def _shifted(mask: np.ndarray, offsets: list[tuple[int, ...]], outside: bool) -> list[np.ndarray]:
    r = max(max(abs(o) for o in offset) for offset in offsets)
    wide = np.pad(mask, r, constant_values=outside)
    return [wide[tuple(slice(r + o, r + o + n) for o, n in zip(offset, mask.shape))] for offset in offsets]


def structure(ndim: int, connectivity: int) -> list[tuple[int, ...]]:
    """Offsets of the neighbourhood: cells that differ in at most ``connectivity`` axes."""
    return [o for o in (tuple(i - 1 for i in index) for index in np.ndindex(*[3] * ndim)) if sum(map(abs, o)) <= connectivity]


def erode(mask: np.ndarray, offsets: list[tuple[int, ...]], outside: bool = True) -> np.ndarray:
    return np.logical_and.reduce(_shifted(mask, offsets, outside))


def dilate(mask: np.ndarray, offsets: list[tuple[int, ...]]) -> np.ndarray:
    return np.logical_or.reduce(_shifted(mask, offsets, False))


def label_components(mask: np.ndarray, connectivity: int | None = None) -> np.ndarray:
    """Connected components, numbered in the order of their first cell; joined by pointer jumping."""
    mask = np.asarray(mask, bool)
    at = np.full(mask.shape, -1, np.int64)
    cells = np.flatnonzero(mask)
    at.reshape(-1)[cells] = np.arange(len(cells))
    root = np.arange(len(cells))
    links = []
    for offset in structure(mask.ndim, connectivity or mask.ndim):
        if offset > (0,) * mask.ndim:
            here = at[tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip(offset, mask.shape))].ravel()
            there = at[tuple(slice(max(0, o), n - max(0, -o)) for o, n in zip(offset, mask.shape))].ravel()
            both = (here >= 0) & (there >= 0)
            links.append(np.stack([here[both], there[both]]))
    a, b = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
    out = np.zeros(mask.shape, np.int32)
    if len(cells):
        out.reshape(-1)[cells] = np.unique(root, return_inverse=True)[1] + 1
    return out


def otsu(values: np.ndarray, low: float, high: float, bins: int = 256) -> float:
    """Centre of the first bin with the largest between-class variance."""
    if not len(values):
        return (low + high) / 2
    count, edge = np.histogram(values, bins, (low, high))
    return otsu_counts(count, (edge[:-1] + edge[1:]) / 2)


def otsu_counts(count: np.ndarray, centre: np.ndarray) -> float:
    """As :func:`otsu`, of a histogram."""
    w, m = np.cumsum(count), np.cumsum(count * centre)
    rest = w[-1] - w
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w * rest * (m / w - (m[-1] - m) / rest) ** 2)
    return float(centre[np.argmax(between)])


def otsu_8bit(gray: np.ndarray) -> int:
    return int(np.floor(otsu(gray.ravel(), -0.5, 255.5)))


def area_filtered(labels: np.ndarray, low: float, high: float) -> np.ndarray:
    """Labels whose area is in [low, high], numbered anew."""
    area = np.bincount(labels.ravel())
    keep = (area >= low) & (area <= high)
    keep[0] = False
    return np.where(keep, np.cumsum(keep), 0).astype(np.int32)[labels]


def segment_gray(gray: np.ndarray, *, min_area: int = 15, max_area_frac: float = 0.25, adaptive: bool = False, offset: float = 3.0, smooth: bool = True) -> np.ndarray:
    """Threshold segmentation of an 8-bit image: smooth, threshold, open and close, label, filter by area."""
    if gray.ndim != 2 or gray.dtype != np.uint8:
        raise ValueError("an 8-bit grey image is needed")
    if not gray.size:
        return np.zeros(gray.shape, np.int32)
    work = np.floor(convolve(gray, np.array([0.25, 0.5, 0.25])) + 0.5) if smooth else gray.astype(np.float64)
    if adaptive:
        block = 31
        sigma = 0.3 * ((block - 1) / 2 - 1) + 0.8
        k = np.exp(-0.5 * (np.arange(block) - block // 2) ** 2 / sigma**2)
        mask = work > np.floor(convolve(work, k / k.sum(), "edge") + 0.5) - offset
    else:
        mask = work > otsu_8bit(work)
    if mask.mean() > 0.5:
        mask = ~mask
    if not mask.any() or mask.all() or abs(work[mask].mean() - work[~mask].mean()) < MIN_CONTRAST:
        return np.zeros(gray.shape, np.int32)
    square = structure(2, 2)
    mask = dilate(erode(mask, square), square)
    mask = erode(dilate(mask, square), square)
    return area_filtered(label_components(mask), min_area, gray.size * max_area_frac)


def segment_nuclei(gray: np.ndarray, *, min_area: int = 20, max_area_frac: float = 0.15, adaptive: bool = False) -> np.ndarray:
    return segment_gray(gray, min_area=min_area, max_area_frac=max_area_frac, adaptive=adaptive, offset=2.0)


def segment_volume(volume: np.ndarray, *, min_voxels: int = 20, connectivity: int = 1) -> np.ndarray:
    """3-D threshold segmentation on the 0.5 to 99.5 percentile stretch; a constant volume has no objects."""
    if volume.ndim != 3 or not volume.size or connectivity not in (1, 2, 3):
        raise ValueError("a non-empty volume and a connectivity of 1 to 3 are needed")
    v = volume.astype(np.float64)
    lo, hi = np.percentile(v[np.isfinite(v)], (0.5, 99.5)) if np.isfinite(v).any() else (0, 0)
    if hi <= lo:
        return np.zeros(volume.shape, np.int32)
    unit = np.clip((np.nan_to_num(v, nan=lo) - lo) / (hi - lo), 0, 1)
    near = structure(3, connectivity)
    mask = unit >= otsu(unit.ravel(), 0, 1)
    mask = dilate(erode(mask, near, False), near)
    mask = erode(dilate(mask, near), near, False)
    return area_filtered(label_components(mask, connectivity), min_voxels, np.inf)


def rescale_to_uint8(image: np.ndarray) -> np.ndarray:
    """Per-channel stretch between the 0.5 and 99.5 percentiles of a strided sample; NaN becomes 0."""
    planes = image[..., None] if image.ndim == 2 else image
    out = np.zeros(planes.shape, np.uint8)
    for c in range(planes.shape[-1]):
        v = planes[..., c].astype(np.float64)
        flat = v.ravel()[:: max(1, v.size // 200_000)]
        flat = flat[np.isfinite(flat)]
        if not len(flat):
            continue
        lo, hi = np.percentile(flat, (0.5, 99.5))
        if hi <= lo and image.ndim == 2:
            lo, hi = np.nanmin(v), np.nanmax(v)
        if hi > lo:
            out[..., c] = (np.clip((np.nan_to_num(v, nan=lo) - lo) / (hi - lo), 0, 1) * 255).astype(np.uint8)
    return out[..., 0] if image.ndim == 2 else out


def to_gray(image: np.ndarray) -> np.ndarray:
    """8-bit grey: luma of colour images."""
    if image.ndim == 2:
        return image if image.dtype == np.uint8 else rescale_to_uint8(image)
    work = image if image.dtype == np.uint8 else rescale_to_uint8(image)
    if work.shape[-1] == 1:
        return work[..., 0]
    if work.shape[-1] not in (3, 4):
        raise ValueError("an image has 1, 3 or 4 channels")
    return np.floor(work[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def focus(gray: np.ndarray) -> float:
    wide = np.pad(gray.astype(np.float64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]).var())


def windows(image: np.ndarray, lengths: list[int], how: np.ufunc) -> dict[int, np.ndarray]:
    """Per length: the extreme of that many cells from each place of a row on (rows get shorter), from windows of powers of two."""
    out, step, span = {}, image, 1
    for length in sorted(lengths):
        while 2 * span <= length:
            step = how(step[:, :-span], step[:, span:])
            span *= 2
        rest = length - span
        out[length] = how(step[:, : step.shape[1] - rest], step[:, rest:])
    return out


def disc_extreme(image: np.ndarray, radius: int, how: np.ufunc, outside: int) -> np.ndarray:
    """Extreme over a disc around each cell.  The disc is a stack of chords, and a chord one window of its row."""
    reach = [int((radius * radius - dy * dy) ** 0.5) for dy in range(radius + 1)]
    wide = np.pad(image, radius, constant_values=outside)
    chords = windows(wide, sorted({2 * r + 1 for r in reach}), how)
    height, width = image.shape
    out = np.full(image.shape, outside, image.dtype)
    for dy in range(-radius, radius + 1):
        half = reach[abs(dy)]
        how(out, chords[2 * half + 1][radius + dy : radius + dy + height, radius - half : radius - half + width], out=out)
    return out


def top_hat(gray: np.ndarray, radius: int = 25) -> np.ndarray:
    """White top-hat with a disc."""
    opened = disc_extreme(disc_extreme(gray, radius, np.minimum, 255), radius, np.maximum, 0)
    return gray - np.minimum(opened, gray)


def perimeters(label: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, cells, border lengths) of labelled cells.  A border is traced by 8-connected steps from the label's first cell (Moore tracing).

    All labels are traced side by side, one step of each at a time; cells are looked up among the sorted ones, so
    memory follows the cells.  Of a label in several parts the one with its first cell counts.
    """
    ids, own, area = np.unique(label, return_inverse=True, return_counts=True)
    length = np.zeros(len(ids))
    if not len(ids):
        return ids, area, length
    y, x = y.astype(np.int64) - int(y.min()) + 1, x.astype(np.int64) - int(x.min()) + 1
    width = int(x.max()) + 2
    size = width * (int(y.max()) + 2)
    cells = np.unique(own * size + y * width + x)  # by label, row and column
    begin = cells[np.searchsorted(cells, np.arange(len(ids)) * size)]
    ring = np.array([-1, -width - 1, -width, -width + 1, 1, width + 1, width, width - 1])
    held = lambda at: cells[np.minimum(np.searchsorted(cells, at), len(cells) - 1)] == at
    here, back, first = begin.copy(), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
    live = np.flatnonzero(held(begin[:, None] + ring).any(axis=1))
    while len(live):
        ways = (back[live, None] + np.arange(1, 9)) % 8
        way = ways[np.arange(len(live)), held(here[live, None] + ring[ways]).argmax(axis=1)]
        open_ = (here[live] != begin[live]) | (first[live] != way)  # closed: the first step again
        live, way = live[open_], way[open_]
        first[live] = np.where(first[live] < 0, way, first[live])
        length[live] += np.where(way % 2 == 1, 2**0.5, 1.0)
        here[live] += ring[way]
        back[live] = (way + 4) % 8  # the search resumes after the cell come from
    return ids, area, length


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost one-to-one assignment (shortest augmenting paths); every row or column of the shorter side is used."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            done[j] = True
            r = match[j]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            j = int(np.argmin(np.where(done[1:], np.inf, least[1:]))) + 1
            step = least[j]
            u[match[done]] += step
            v[done] -= step
            least[~done] -= step
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


#: Pairs up to so many are all compared, at once; beyond it points meet those of the cells around theirs.
FEW_PAIRS = 4096


def near_pairs(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the points of b within the limit of each of a, through cells as wide as the largest limit."""
    rows, columns = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (a, b))
    if not len(rows) or not len(columns):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if len(rows) * len(columns) <= FEW_PAIRS:
        d = np.sqrt(((a[rows][:, None] - b[columns]) ** 2).sum(axis=2))
        r, c = np.nonzero(d <= limit[rows][:, None])
        return rows[r], columns[c], d[r, c]
    low = np.minimum(a[rows].min(axis=0), b[columns].min(axis=0))
    span = np.maximum(a[rows].max(axis=0), b[columns].max(axis=0)) - low
    side = max(float(limit.max()), float(span.max()) / 1e5, 1e-300)  # cells numbered within 64 bits
    strides = np.cumprod([1, *(np.floor(span / side).astype(np.int64) + 3)[:-1]])
    cell = lambda x: (np.floor((x - low) / side).astype(np.int64) + 1) @ strides
    order = columns[np.argsort(cell(b[columns]), kind="stable")]
    filled, own, out = cell(b[order]), cell(a[rows]), []
    for step in np.ndindex(*[3] * a.shape[1]):
        wanted = own + (np.array(step) - 1) @ strides
        first, stop = np.searchsorted(filled, wanted, "left"), np.searchsorted(filled, wanted, "right")
        many = stop - first
        r = np.repeat(rows, many)
        c = order[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        d = np.sqrt(((a[r] - b[c]) ** 2).sum(axis=1))
        near = d <= limit[r]
        out.append((r[near], c[near], d[near]))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def linked_groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes, the least one that each reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def sparse_assign(a: np.ndarray, b: np.ndarray, limit: np.ndarray, beyond: float | None = None) -> list[tuple[int, int, float]]:
    """Optimal one-to-one (row, column, distance) within each row's limit: groups of points that are near are solved alone.

    Pairs beyond the limit cost ``beyond``; without it more than all allowed ones, so that as many pairs as can be are
    matched.  No matrix is larger than a group's.
    """
    r, c, d = near_pairs(a, b, limit)
    group = linked_groups(len(a) + len(b), r, len(a) + c)[r]
    order = np.argsort(group, kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(at) == 1:
            out.append((int(r[at[0]]), int(c[at[0]]), float(d[at[0]])))
        elif len(at):
            rows, i = np.unique(r[at], return_inverse=True)
            columns, j = np.unique(c[at], return_inverse=True)
            cost = np.full((len(rows), len(columns)), d[at].sum() + float(limit.max()) + 1 if beyond is None else beyond)
            allowed = np.zeros(cost.shape, bool)
            cost[i, j], allowed[i, j] = d[at], True
            out += [(int(rows[x]), int(columns[y]), float(cost[x, y])) for x, y in assign(cost) if allowed[x, y]]
    return sorted(out)


#: MD5 (RFC 1321): what a step adds, how far it turns, which word it takes, and the state at the start.
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
MD5_WORDS = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(data: np.ndarray, lengths: np.ndarray, ahead: int) -> np.ndarray:
    """MD5's words (words, messages) of the messages, of one block each, that stand one behind the other in ``data``.

    ``ahead`` bytes in front of each are left zero, for what many rounds put there.
    """
    every, ends = np.arange(len(lengths)), lengths + ahead
    out = np.zeros((len(lengths), 64), np.uint8)
    out[:, ahead:][np.arange(64 - ahead) < lengths[:, None]] = data
    out[every, ends] = 0x80
    out.view("<u8")[:, 7] = 8 * ends
    return np.ascontiguousarray(out.view("<u4").T)


def md5(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The four little-endian words of the digests (4, n) of ``n`` messages of one block; a word that all share may be a number."""
    state = np.repeat(np.array(MD5_START, np.uint32)[:, None], n, axis=1)
    a, b, c, d = state.copy()
    f, t = np.empty_like(a), np.empty_like(a)
    for i, (added, turn, at) in enumerate(zip(MD5_ADDED, MD5_TURNS, MD5_WORDS)):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:  # c ^ (b | ~d)
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        a += f
        word = words[at]
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((word + added) % 2**32)
        np.left_shift(a, np.uint32(turn), out=t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    for x, y in zip(state, (a, b, c, d)):
        x += y
    return state
