"""Sparse assignment against the dense solver, and at a size no dense matrix of which would fit."""

import time

import numpy as np
import pytest

from lumenframe.functions import kernels


@pytest.mark.parametrize("axes", [1, 2, 3])
@pytest.mark.parametrize("beyond", [None, 4.0])
def test_equals_the_dense_solver(axes, beyond):
    rng = np.random.default_rng(axes)
    for n, m, spread in ((0, 4, 10), (5, 0, 10), (1, 1, 2), (30, 25, 12), (25, 40, 30), (60, 60, 8)):
        a, b = rng.random((n, axes)) * spread, rng.random((m, axes)) * spread
        limit = rng.random(n) * 2 + 1 if beyond is None else np.full(n, 3.0)
        got = kernels.sparse_assign(a, b, limit, beyond)
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        allowed = d <= limit[:, None]
        far = (d[allowed].sum() + limit.max(initial=0) + 1) if beyond is None else beyond
        want = [(r, c) for r, c in kernels.assign(np.where(allowed, d, far)) if allowed[r, c]]
        assert len({r for r, _, _ in got}) == len({c for _, c, _ in got}) == len(got)
        assert all(d[r, c] == pytest.approx(x) and allowed[r, c] for r, c, x in got)
        if beyond is None:
            assert len(got) == len(want) and sum(x for *_, x in got) == pytest.approx(sum(d[p] for p in want))
        else:
            assert sum(x - far for *_, x in got) == pytest.approx(sum(d[p] - far for p in want))


def test_missing_places_and_many_objects():
    a, b = np.array([[0.0, np.nan], [1.0, 1.0]]), np.array([[1.0, 1.5], [np.inf, 0.0]])
    assert kernels.sparse_assign(a, b, np.array([5.0, 5.0])) == [(1, 0, 0.5)]
    rng = np.random.default_rng(9)
    a = rng.random((100_000, 2)) * 10_000
    b = a + rng.normal(size=a.shape)
    began = time.perf_counter()
    got = kernels.sparse_assign(a, b, np.full(len(a), 5.0))
    assert len(got) > 98_000 and np.mean([r == c for r, c, _ in got]) > 0.9 and time.perf_counter() - began < 60


def test_few_points_are_compared_at_once(monkeypatch):
    """two objects a frame took the search through 27 cells; both ways give the same pairs."""
    rng = np.random.default_rng(6)
    for n, m, axes in ((2, 2, 3), (1, 40, 2), (60, 60, 3)):
        a, b = rng.normal(size=(n, axes)), rng.normal(size=(m, axes))
        a[0, 0], limit = np.nan if n > 1 else 0.0, rng.uniform(0.5, 2, n)
        few = sorted(zip(*map(np.ndarray.tolist, kernels.near_pairs(a, b, limit))))
        with monkeypatch.context() as m_:
            m_.setattr(kernels, "FEW_PAIRS", 0)
            assert few == sorted(zip(*map(np.ndarray.tolist, kernels.near_pairs(a, b, limit))))
