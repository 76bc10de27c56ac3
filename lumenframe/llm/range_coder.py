"""Adaptive context-mixing range coder over token ids, run in lanes, in integer arithmetic alone.

A block's ids are cut into lanes of consecutive ids, which are coded side by side: step ``t`` codes id ``t``
of every lane.  All lanes share one adaptive model, which both sides update alike:

* order 2 and order 1: a table from the last two ids (hashed), or the last one, to the id that followed and
  a confidence, updated after each step;
* order 0: id frequencies, refreshed at the steps of :func:`_refreshes`.

The chances that the order-2 and the order-1 id come next are mixed, in the logistic domain with weights
learned as coding goes, from three predictions: that of the order-2 confidence, of the order-1 confidence
and of both with their agreement.  Ids that neither predicts are coded by order 0.  Chances, weights and the
logistic function are fixed-point numbers, so blocks decode alike on every machine.

A block is reset on its own.  Its header and bytes are under one checksum, its ids under another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Lanes of a full block, steps of a block at least, slots of the order-2 table, steps between refreshes at most.
LANES, MIN_STEPS, HASH_BITS, REFRESH = 4096, 64, 18, 32
FLAG_BITS, TOTAL_BITS, LEVEL_BITS = 12, 20, 4
#: Ids are below this; order 0 keeps a share for each.
MAX_VOCABULARY = 1 << 19
_FLAGS, _LEVELS = 1 << FLAG_BITS, 1 << LEVEL_BITS
_CONTEXTS = 2 * _LEVELS * _LEVELS
_HEAD, _SUM = struct.Struct("<4sIIIII"), struct.Struct("<I")
_MAGIC = b"LRC2"
_WORD, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)

#: The logistic function, in 4096ths, at -8, -7.5, ..., 8.
LOGISTIC = [1, 2, 4, 6, 10, 17, 27, 45, 74, 120, 194, 311, 488, 747, 1102, 1546, 2048, 2550, 2994, 3349, 3608, 3785, 3902, 3976, 4022, 4051, 4069, 4079, 4086, 4090, 4092, 4094, 4095]


class BlockError(ValueError):
    """A block's bytes, header or ids don't match their checksum."""


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """The function between its knots, by 256ths, and its inverse."""
    knots, r = np.array(LOGISTIC, np.int64), np.arange(128)
    squash = ((knots[:-1, None] * (128 - r) + knots[1:, None] * r + 64) >> 7).ravel()
    return squash, np.minimum(np.searchsorted(squash, np.arange(_FLAGS)), len(squash) - 1) - 2048


_SQUASH, _STRETCH = _logistic()


class _Mixer:
    """Chances (of 4096) by context: order-2 level, order-1 level, agreement; mixed from three adaptive predictions."""

    def __init__(self, hits: int) -> None:
        c = np.arange(_CONTEXTS)
        self.groups = [c // (2 * _LEVELS), c // 2 % _LEVELS, c]
        self.all = [np.full(int(g.max()) + 1, 32, np.int64) for g in self.groups]  # sixteenths
        self.hit = [np.full(len(n), hits, np.int64) for n in self.all]
        self.weights = [26214, 13107, 32768]  # 65536ths
        self.refresh()

    def refresh(self) -> None:
        self.inputs = [_STRETCH[np.clip((h * _FLAGS // n), 8, _FLAGS - 8)][g] for h, n, g in zip(self.hit, self.all, self.groups)]
        mixed = sum(w * x for w, x in zip(self.weights, self.inputs)) >> 16
        self.chance = _SQUASH[np.clip(mixed, -2048, 2047) + 2048]

    def learn(self, hits: np.ndarray, seen: np.ndarray) -> None:
        total = int(seen.sum())
        if total:
            wrong = hits * _FLAGS - seen * self.chance
            self.weights = [w + 3 * int((x * wrong).sum()) // (160 * total) for w, x in zip(self.weights, self.inputs)]
        for k, g in enumerate(self.groups):
            h, n = np.zeros_like(self.hit[k]), np.zeros_like(self.all[k])
            np.add.at(h, g, hits)
            np.add.at(n, g, seen)
            self.hit[k] += 16 * h - (self.hit[k] >> 6)
            self.all[k] += 16 * n - (self.all[k] >> 6)
        self.refresh()


class _Model:
    def __init__(self, vocabulary: int, lanes: int, decodes: bool = False) -> None:
        self.size, self.decodes = vocabulary, decodes
        self.next2 = np.zeros(1 << HASH_BITS, np.uint32)  # id << LEVEL_BITS | confidence
        self.next1 = np.zeros(vocabulary + 1, np.uint32)
        self.last = np.full(lanes, vocabulary, np.uint32)
        self.before = np.full(lanes, vocabulary, np.uint32)
        self.counts = np.ones(vocabulary, np.int64)
        self.mix2, self.mix1 = _Mixer(13), _Mixer(6)
        self.events: list[np.ndarray] = []
        self.literals: list[np.ndarray] = []
        self._tables()

    def _tables(self) -> None:
        """Order-0 frequencies, of which every id keeps one, and the starts and sizes of the three outcomes by context."""
        scale = (((1 << TOTAL_BITS) - self.size) << 24) // int(self.counts.sum())
        freq = 1 + (self.counts * scale >> 24)
        upto = np.cumsum(freq)
        self.freq, self.start0 = freq.astype(np.uint32), (upto - freq).astype(np.uint32)
        self.owner = np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.uint32), freq) if self.decodes else None
        size2 = np.clip(self.mix2.chance, 1, _FLAGS - 128)
        # The order-1 chance is of what order 2 leaves, and there is none where both name the same id.
        left = _FLAGS - 64 - size2
        size1 = np.clip(self.mix1.chance * left >> FLAG_BITS, 1, left - 1)
        size1[1::2] = 0
        self.starts = np.stack([np.zeros_like(size2), size2, size2 + size1], axis=1).ravel().astype(np.uint32)
        self.sizes = np.stack([size2, size1, _FLAGS - size2 - size1], axis=1).ravel().astype(np.uint32)

    def predict(self, n: int) -> None:
        """Ids that order 2 and order 1 name for the first ``n`` lanes, and where their outcomes begin in the tables."""
        last = self.last[:n]
        slot = last * np.uint32(0x9E3779B1) ^ self.before[:n] * np.uint32(0x85EBCA77)
        self.slot = (slot ^ slot >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - HASH_BITS)
        self.slot, self.spot = self.slot.astype(np.int64), last.astype(np.int64)
        self.entry2, self.entry1 = self.next2.take(self.slot), self.next1.take(self.spot)
        self.guess2, self.guess1 = self.entry2 >> np.uint32(LEVEL_BITS), self.entry1 >> np.uint32(LEVEL_BITS)
        self.level2, self.level1 = self.entry2 & np.uint32(_LEVELS - 1), self.entry1 & np.uint32(_LEVELS - 1)
        context = self.level2 << np.uint32(LEVEL_BITS + 1) | self.level1 << np.uint32(1) | (self.guess1 == self.guess2)
        self.event = context.astype(np.int64) * 3

    def update(self, ids: np.ndarray, event: np.ndarray, rest: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Learn one step: ``event`` is the context and outcome of each lane, ``rest`` the lanes of order-0 ids."""
        n = len(ids)
        fresh = ids << np.uint32(LEVEL_BITS)
        for table, at, entry, level, hit in (
            (self.next2, self.slot, self.entry2, self.level2, hit2),
            (self.next1, self.spot, self.entry1, self.level1, hit1),
        ):
            missed = np.where(level > 1, entry - (level + np.uint32(1) >> np.uint32(1)), fresh)
            table[at] = np.where(hit, entry + (level < _LEVELS - 1), missed)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.events.append(event)
        self.literals.append(ids[rest])

    def refresh(self) -> None:
        seen = np.bincount(np.concatenate(self.events), minlength=3 * _CONTEXTS).reshape(-1, 3)
        self.counts += 16 * np.bincount(np.concatenate(self.literals), minlength=self.size)
        self.events.clear()
        self.literals.clear()
        self.mix2.learn(seen[:, 0], seen.sum(axis=1))
        asked = seen[:, 1] + seen[:, 2]
        asked[1::2] = 0
        self.mix1.learn(seen[:, 1], asked)
        self._tables()


def _refreshes(steps: int) -> set[int]:
    """Steps after which the chances are refreshed: 1, 2, 4, ... and then each eighth of all, of 8 to ``REFRESH`` steps."""
    every = max(8, min(REFRESH, steps // 8))
    return {t for t in range(1, steps) if t % every == 0 or t & t - 1 == 0}


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of n ids."""
    lanes = max(1, min(LANES, n // MIN_STEPS))
    return lanes, -(-n // lanes)


def _places(n: int, lanes: int, steps: int) -> tuple[np.ndarray, list[int]]:
    """Where each lane begins, and how many lanes each step has: the longer lanes come first."""
    sizes = np.full(lanes, n // lanes)
    sizes[: n % lanes] += 1
    active = [lanes] * steps
    if n % lanes:
        active[-1] = n % lanes
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)[:-1]]), active


def _renew(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes that settle a word; an interval that lies across a word's bound is cut to the part below it."""
    at = np.flatnonzero(width <= _LOW)
    if len(at):
        lo, wide = low.take(at), width.take(at)
        across = ((lo + wide - np.uint64(1)) ^ lo) > _LOW
        width[at] = np.where(across, ~lo + np.uint64(1) & _LOW, wide) << _WORD
    return at


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One independently decodable block of ids below ``vocabulary``."""
    if not 0 < vocabulary <= MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of 1 to {MAX_VOCABULARY} ids is coded, not of {vocabulary}")
    ids = np.asarray(ids)
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary:
        raise ValueError("an id lies outside the vocabulary")
    ids = np.ascontiguousarray(ids, "<u4")
    if n == 0:
        return _seal(ids, vocabulary, 0, b"")
    lanes, steps = _shape(n)
    begin, active = _places(n, lanes, steps)
    refreshes = _refreshes(steps)
    model = _Model(vocabulary, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    who: list[np.ndarray] = []
    words: list[np.ndarray] = []
    for t, k in enumerate(active):
        x = ids[begin[:k] + t]
        model.predict(k)
        hit2, hit1 = x == model.guess2, x == model.guess1
        outcome = (np.uint8(2) - hit1) * ~hit2  # 0: order 2, 1: order 1, 2: neither
        event = model.event + outcome
        lo, wide = low[:k], width[:k]
        unit = wide >> np.uint64(FLAG_BITS)
        lo += unit * model.starts.take(event)
        np.multiply(unit, model.sizes.take(event), out=wide)
        rest = np.flatnonzero(outcome == 2)
        y = x.take(rest).astype(np.int64)
        unit = wide.take(rest) >> np.uint64(TOTAL_BITS)
        lo[rest] = lo.take(rest) + unit * model.start0.take(y)
        wide[rest] = unit * model.freq.take(y)
        at = _renew(lo, wide)
        who.append(at)
        words.append((lo.take(at) >> _WORD).astype("<u4"))
        lo[at] = lo.take(at) << _WORD
        model.update(x, event, rest, hit2, hit1)
        if t + 1 in refreshes:
            model.refresh()
    # A word settles a lane: its interval is wider than what follows a word.
    who.append(np.arange(lanes))
    words.append((low + _LOW >> _WORD).astype("<u4"))
    lane, stream = np.concatenate(who).astype(np.uint16), np.concatenate(words)
    lengths = np.bincount(lane, minlength=lanes).astype("<u4")
    return _seal(ids, vocabulary, lanes, lengths.tobytes() + stream[np.argsort(lane, kind="stable")].tobytes())


def _seal(ids: np.ndarray, vocabulary: int, lanes: int, body: bytes) -> bytes:
    block = _HEAD.pack(_MAGIC, len(ids), vocabulary, lanes, len(body), zlib.crc32(ids.tobytes())) + body
    return block + _SUM.pack(zlib.crc32(block))


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; :class:`BlockError` where a checksum fails."""
    if len(block) < _HEAD.size + _SUM.size:
        raise BlockError("a block is cut short")
    magic, n, vocabulary, lanes, size, crc = _HEAD.unpack_from(block)
    if zlib.crc32(memoryview(block)[: -_SUM.size]) != _SUM.unpack_from(block, len(block) - _SUM.size)[0]:
        raise BlockError("a block's bytes don't match their checksum")
    if magic != _MAGIC or size != len(block) - _HEAD.size - _SUM.size or lanes != (_shape(n)[0] if n else 0) or not 0 < vocabulary <= MAX_VOCABULARY:
        raise BlockError("a block's header is not of this format")
    if n == 0:
        return np.empty(0, np.uint32)
    steps = _shape(n)[1]
    begin, active = _places(n, lanes, steps)
    refreshes = _refreshes(steps)
    lengths = np.frombuffer(block, "<u4", lanes, _HEAD.size).astype(np.int64)
    stream = np.frombuffer(block, "<u4", (size - 4 * lanes) // 4, _HEAD.size + 4 * lanes)
    if int(lengths.sum()) != len(stream):
        raise BlockError("a block's lanes don't add up to its bytes")
    stream = np.concatenate([stream, np.zeros(1, "<u4")]).astype(np.uint64)  # a zero word, read past a lane's end
    spare, end = len(stream) - 1, np.cumsum(lengths)
    place = end - lengths
    code = np.zeros(lanes, np.uint64)
    for _ in range(2):
        code = code << _WORD | stream[np.where(place < end, place, spare)]
        place += 1
    out = np.zeros(n, np.uint32)
    model = _Model(vocabulary, lanes, decodes=True)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    for t, k in enumerate(active):
        model.predict(k)
        lo, wide = low[:k], width[:k]
        unit = wide >> np.uint64(FLAG_BITS)
        gone = code[:k] - lo
        first = gone >= unit * model.sizes.take(model.event)  # sizes of outcome 0 end where outcome 1 begins
        outcome = first.view(np.uint8) + (gone >= unit * model.starts.take(model.event + 2))
        event = model.event + outcome
        lo += unit * model.starts.take(event)
        np.multiply(unit, model.sizes.take(event), out=wide)
        x = np.where(first, model.guess1, model.guess2)
        rest = np.flatnonzero(outcome == 2)
        unit, under = wide.take(rest) >> np.uint64(TOTAL_BITS), lo.take(rest)
        point = np.minimum((code.take(rest) - under) // unit, np.uint64(len(model.owner) - 1)).astype(np.int64)
        x[rest] = y = model.owner.take(point)
        y = y.astype(np.int64)
        lo[rest] = under + unit * model.start0.take(y)
        wide[rest] = unit * model.freq.take(y)
        at = _renew(lo, wide)
        lo[at] = lo.take(at) << _WORD
        spot = place.take(at)
        code[at] = code.take(at) << _WORD | stream.take(np.where(spot < end.take(at), spot, spare))
        place[at] = spot + 1
        model.update(x, event, rest, x == model.guess2, x == model.guess1)
        out[begin[:k] + t] = x
        if t + 1 in refreshes:
            model.refresh()
    ids = out.astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise BlockError("a block's ids don't match their checksum")
    return ids
