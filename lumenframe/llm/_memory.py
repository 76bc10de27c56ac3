"""Bounds on what a Python worker holds: one cache at a time, and slices of Arrow batches by bytes of text."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of one slice (a longer text is a slice of its own), and of what a cache may keep, about.
SLICE_BYTES, CACHE_BYTES = 2 << 20, 192 << 20

Held = TypeVar("Held")
_HELD: dict[object, object] = {}


def give_back() -> None:
    """Memory that a dropped cache took goes back to the system, as far as the allocators can tell."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def claim(key: object, make: Callable[[], Held]) -> Held:
    """This worker's cache under ``key``; workers are used again, so one that another operator left goes first."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about ``limit`` bytes of ``column`` (string or binary); nulls have none."""
    limit = SLICE_BYTES if limit is None else limit
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(batch):
            before = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
