"""Scores of whole texts by their blank-separated words, with each distinct word looked at once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from lumenframe.llm._memory import CACHE_BYTES, claim
from lumenframe.llm._pieces import _Index

#: Bytes that the cache holds of a word, besides its characters and values, about.
WORD_BYTES = 180


def scorer(key: str, width: int, part: Callable[[str], Sequence[float]], **options: bool) -> WordScorer:
    """This worker's scorer of a model; ``key`` names the model."""
    return claim(("scorer", key), lambda: WordScorer(width, part, **options))


class WordScorer:
    """What is known of the words of texts: ``part(word)``, ``width`` numbers and, if ``flagged``, bits behind them."""

    def __init__(self, width: int, part: Callable[[str], Sequence[float]], *, flagged: bool = False, lower: bool = False) -> None:
        self.width, self.part, self.flagged, self.lower = width, part, flagged, lower
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.values = np.empty((1024, self.width))
        self.bits = np.zeros(1024, np.uint64)
        self.held = 0

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows, in ``values`` and ``bits``, of all words of all texts in turn, and each text's count of words."""
        if self.held > CACHE_BYTES:  # the cache starts afresh; results don't change
            self._reset()
        words = [text.lower().split() for text in texts] if self.lower else list(map(str.split, texts))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        new = self.index.pending
        if new:
            n, many = len(self.index), len(new)
            if n > len(self.values):
                more = max(n, 2 * len(self.values)) - len(self.values)
                self.values = np.concatenate([self.values, np.empty((more, self.width))])
                self.bits = np.concatenate([self.bits, np.zeros(more, np.uint64)])
            found = list(map(self.part, new))
            if self.flagged:
                self.bits[n - many : n] = [x[-1] for x in found]
                found = [x[:-1] for x in found]
            self.values[n - many : n] = found
            self.held += (WORD_BYTES + 16 * self.width) * many + 2 * sum(map(len, new))
            new.clear()
        return at, counts

    def sums(self, texts: list[str]) -> np.ndarray:
        """The vectors of each text's words added up."""
        at, counts = self.words(texts)
        return added(self.values[at], counts, np.add)


def added(rows: np.ndarray, counts: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` over the rows of each text; nothing gives 0."""
    out = np.zeros((len(counts), *rows.shape[1:]), rows.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = how.reduceat(rows, np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[full])[:-1]]), axis=0)
    return out
